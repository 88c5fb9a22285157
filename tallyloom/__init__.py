"""tallyloom: frequent-pattern mining as ordinary Spark DataFrame operators."""
