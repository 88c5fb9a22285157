"""Cross-tokenizer alignment: which tokens of one vocabulary end where tokens of another end, and how often each pair does in the corpus.

Texts are encoded by a byte-level BPE (A) and a sentencepiece model (B, which adds a space in front), and cut into groups where tokens
of both end. The two last tokens of a group are a link. Counting:

1. Links are packed as int64 keys, b << 32 | a. Each slice of documents gives its distinct keys and how often it has them (np.unique).
2. These partial counts are put in order by ranges of keys, and equal keys, now neighbours, are summed up as runs: the corpus-wide
   counts as sorted shards.
3. A slice asks each shard for its keys in one row. The shard is memory-mapped in the task and searched with searchsorted.
4. The answers meet the slice's documents again. Which count is the highest of a B id is a table of B's size.

So what is shuffled is a slice's distinct keys, not the corpus's links, but for the documents' own links once.

Encoding is the dear part, and both tokenizers treat the parts of a text between certain spaces and line ends alike wherever they stand
(Units.cuts says when that holds for a vocabulary). What they make of a part is therefore kept and looked up by its text.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import drop_written, slices, spare, written

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text of a slice, keys of a shard, and slices that ask one copy of a shard, about.
SLICE_BYTES, SHARD_KEYS, ASKING = 16_000_000, 32_768, 64
#: Parts of texts that a worker keeps, twice at most, and characters of texts that it encodes at once.
KEPT_PARTS, RUN_CHARS = 200_000, 2_000_000
#: A part begins with one space between other characters, or with a line end after one.
_CUT = re.compile(r"(?<=\S)(?= \S|\n)")
_LOW = np.int64(0xFFFFFFFF)
#: Fixed value: the pattern by which byte-level vocabularies split words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Units:
    """Both tokenizers, and what they make of the parts of texts met lately, by the part's text: its groups as text, the packed keys of its
    links, and its numbers of A and B tokens; None if the tokens don't give it back."""

    def __init__(self, a: bytes, b: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        self.b = SentencePieceProcessor(model_proto=b)
        letters = byte_level()
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for t, i in names.items():
            self.a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        described = json.loads(self.a.to_str())
        self.cut = self.cuts(described, pieces)
        self.fast = self.by_ranks(described) if self.cut else None
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.key = np.uint32 if max(len(self.a_bytes), len(pieces)) <= 1 << 16 else np.int64
        self.shift = 16 if self.key is np.uint32 else 32
        # each id with what comes after it, as text: within a group of A, at its end, within a group of B, at its end
        self.said = np.array([f"{i}{end}" for x, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(x))], object)
        self.young: dict[str | tuple, tuple | None] = {}
        self.old: dict[str | tuple, tuple | None] = {}

    @staticmethod
    def cuts(a: dict, pieces: list[str]) -> bool:
        """Whether tokens never reach over a cut: A splits words by the usual byte-level pattern, B has no piece in which a space
        follows another character and none of several characters with a line end."""
        split = a.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not a.get("normalizer")
        return bool(plain) and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def by_ranks(self, a: dict):
        """A as an encoding by ranks, some three times as fast, if its ids are in the order of its merges; else None.

        Such an encoding joins two neighbours by the id of what they make, which is the merge's place then.
        """
        import tiktoken

        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in a["model"].get("merges", [])]
        ids, first = a["model"].get("vocab", {}), 256
        if len(ids) - first not in (len(made), len(made) + len(a.get("added_tokens", []))) or any(ids.get(t) != first + k for k, t in enumerate(made)) or a["model"].get("dropout"):
            return None
        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={self.a_bytes[k]: k for k in range(first + len(made))}, special_tokens={})

    def encoded_a(self, parts: list[str]) -> list[list[int]]:
        """A's tokens. The fast encoding takes parts of Latin letters, of which all versions of the character tables say the same."""
        plain = [self.fast is not None and (p.isascii() or max(p) < "\u0250") for p in parts]
        slow = iter(self.a.encode_batch([p for p, x in zip(parts, plain, strict=True) if not x], add_special_tokens=False))
        return [self.fast.encode_ordinary(p) if x else next(slow).ids for p, x in zip(parts, plain, strict=True)]

    def parts(self, text: str) -> list[str | tuple]:
        """The parts of a text by the names under which they are kept: without the space in front, or with the line end; others as a tuple.

        If only single spaces and line ends stand between the words, all of them are cuts.
        """
        if self.cut and " ".join(text.split()) == text.replace("\n", " "):
            return text.replace("\n", " \n").split(" ")
        return [(p,) if p[:2] == " \n" else p if p[0] == "\n" else p[1:] for p in (_CUT.split(f" {text}") if self.cut else [f" {text}"])]

    def learn(self, names: list[str | tuple]) -> None:
        """Encodes and aligns parts. B adds a space in front, which a part that begins with a line end doesn't have.

        Tokens of several parts are one run of bytes; where an A token and a B token end at the same place is the end of a group.
        """
        parts = [p[0] if isinstance(p, tuple) else p if p[:1] == "\n" else f" {p}" for p in names]
        found_a = self.encoded_a(parts)
        found_b = self.b.encode([p if p[0] == "\n" else p[1:] for p in parts], num_threads=1)
        found_b = [x[1:] if p[0] == "\n" else x for x, p in zip(found_b, parts, strict=True)]
        self.young |= dict.fromkeys(names)
        good = [k for k, part in enumerate(parts) if b"".join([self.a_bytes[i] for i in found_a[k]]) == part.encode() == b"".join([self.b_bytes[i] for i in found_b[k]])]
        if not good:
            return
        n_a, n_b = (np.array([len(x[k]) for k in good]) for x in (found_a, found_b))
        a, b = (np.fromiter(chain.from_iterable(x[k] for k in good), np.int64) for x in (found_a, found_b))
        end_a, end_b = self.size_a[a].cumsum(), self.size_b[b].cumsum()
        at = np.searchsorted(end_b, end_a)
        ends = end_b[at] == end_a
        links = (b[at[ends]] << self.shift | a[ends]).astype(self.key)
        last = end_a[ends]  # of each group
        done = np.zeros(len(b), bool)
        done[at[ends]] = True
        group = np.concatenate([np.searchsorted(last, end_a), np.searchsorted(last, end_b)])
        code = np.concatenate([a + len(self.a_bytes) * ends, b + len(self.b_bytes) * done + 2 * len(self.a_bytes)])
        side = np.repeat([0, 1], [len(a), len(b)])
        text = self.said[code[np.argsort(2 * group + side, kind="stable")]].tolist()
        to_link = np.searchsorted(last, end_a[n_a.cumsum() - 1], "right").tolist()
        to_token = (n_a + n_b).cumsum().tolist()
        raw, size = links.tobytes(), links.itemsize
        i = j = 0
        for k, x, y, na, nb in zip(good, to_token, to_link, n_a.tolist(), n_b.tolist(), strict=True):
            self.young[names[k]] = "".join(text[i:x]), raw[j * size : y * size], na, nb
            i, j = x, y

    def of(self, texts: list[str]) -> list[tuple | None]:
        """For each text its groups as text, the packed keys of its links, and its numbers of A and B tokens; None without tokens."""
        cut = [self.parts(t) if t else None for t in texts]
        todo = []
        for p in set().union(*filter(None, cut)).difference(self.young):
            if p in self.old:
                self.young[p] = self.old[p]
            else:
                todo.append(p)
        self.learn(todo)
        out = []
        for parts in cut:
            found = parts and list(map(self.young.__getitem__, parts))
            if not found or None in found:
                out.append(None)
                continue
            said, links, n_a, n_b = zip(*found, strict=True)
            out.append(("".join(said)[:-1], b"".join(links), sum(n_a), sum(n_b)))
        if len(self.young) > KEPT_PARTS:
            self.old, self.young = self.young, {}
        return out


_units: dict[bytes, Units] = {}


def units_of(a: bytes, b: bytes) -> Units:
    """The worker's own, so that its later tasks know the parts that are met often."""
    key = hashlib.sha256(a + b).digest()
    if key not in _units:
        _units.clear()
        _units[key] = Units(a, b)
    return _units[key]


def _several(column: pa.Array):
    """The texts of a batch in runs of some 2 MB."""
    run, size = [], 0
    for t in column:
        t = t.as_py()
        run.append(t)
        size += len(t or "")
        if size > RUN_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def _files(docs: DataFrame, a_path: str, b_path: str):
    """The tokenizers' files, read on the driver (a few MB) and broadcast, so that executors need no copy of their own."""
    read = lambda p: open(p, "rb").read()
    return docs.sparkSession.sparkContext.broadcast((read(a_path), read(b_path)))


def _small(files) -> bool:
    """Whether both vocabularies' ids fit 16 bits; keys are then kept in 32."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    return max(Tokenizer.from_buffer(files[0]).get_vocab_size(True), SentencePieceProcessor(model_proto=files[1]).get_piece_size()) <= 1 << 16


def _keys(raw, small: bool) -> np.ndarray:
    if not small:
        return np.frombuffer(raw, np.int64)
    x = np.frombuffer(raw, np.uint32).astype(np.int64)
    return (x >> 16 << 32) | (x & 0xFFFF)


def _encoded(docs: DataFrame, files, small: bool, keep: list[str], text: str, groups: str, digest: bool) -> DataFrame:
    """Columns `keep`, the row's slice, its numbers, groups, and the distinct keys of its links with their numbers."""
    last = spare(docs, "text_of")
    x = docs.select(*keep, F.col(text).cast("string").alias(last))
    made = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField(groups, T.StringType())]
    hidden = [T.StructField("slice_", T.LongType()), T.StructField("keys_", T.BinaryType()), T.StructField("times_", T.BinaryType())]
    schema = T.StructType([*x.drop(last).schema.fields, *made, *hidden])

    def run(batches):
        units, size, at = units_of(*files.value), 0, TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            rows = []
            for texts in _several(batch.column(len(keep))):
                for t, found in zip(texts, units.of(texts), strict=True):
                    if found is None:
                        rows.append((0, 0, 0, 0, "", at, b"", b""))
                        continue
                    said, links, a, b = found
                    keys = np.frombuffer(links, units.key)
                    one, times = np.unique(keys, return_counts=True)
                    rows.append((a, b, len(keys), len(keys), hashlib.sha256(said.encode()).hexdigest() if digest else said, at, one.tobytes(), times.astype(np.uint32).tobytes()))
                    size += len(t)
                    if size > SLICE_BYTES:
                        at, size = at + 1, 0
            cols = [pa.array(c, f) for c, f in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=schema.names)

    return x.mapInArrow(run, schema)


def _partial(encoded: DataFrame, small: bool) -> DataFrame:
    """(slice_, keys, times): the distinct keys of each slice in order (int64), with how often it has them."""

    def run(batches):
        at, keys, times = None, [], []

        def out():
            k = np.concatenate(keys)
            one, where = np.unique(k, return_inverse=True)
            n = np.bincount(where, np.concatenate(times).astype(np.float64), len(one)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([one.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["slice_", "keys", "times"])

        for batch in slices(batches):
            for s, k, t in zip(*(batch.column(c) for c in range(3)), strict=True):
                if not len(k.as_buffer()):
                    continue
                if s.as_py() != at and keys:
                    yield out()
                    keys, times = [], []
                at = s.as_py()
                keys.append(_keys(k.as_buffer(), small))
                times.append(np.frombuffer(t.as_buffer(), np.uint32))
        if keys:
            yield out()

    return encoded.select("slice_", "keys_", "times_").mapInArrow(run, "slice_ long, keys binary, times binary")


def _rows(partial: DataFrame) -> DataFrame:
    """(key, n) of the slices, a row for each."""

    def run(batches):
        for batch in slices(batches):
            for k, n in zip(batch.column(0), batch.column(1), strict=True):
                k, n = (np.frombuffer(x.as_buffer(), np.int64) for x in (k, n))
                for at in range(0, len(k), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(k[at : at + 100_000]), pa.array(n[at : at + 100_000])], names=["key", "n"])

    return partial.select("keys", "times").mapInArrow(run, "key long, n long")


def _shards(partial: DataFrame) -> DataFrame:
    """(shard, keys, totals): the corpus's counts in the order of the keys, SHARD_KEYS in a row; a shard's name is its first key."""

    def run(batches):
        keys, totals = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(n):
            return pa.RecordBatch.from_arrays([pa.array(keys[:1]), pa.array([keys[:n].tobytes()], pa.binary()), pa.array([totals[:n].tobytes()], pa.binary())], names=["shard", "keys", "totals"])

        for batch in batches:
            k = np.concatenate([keys, batch.column(0).to_numpy()])
            n = np.concatenate([totals, batch.column(1).to_numpy()])
            if not len(k):
                continue
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            keys, totals = k[starts], np.add.reduceat(n, starts)
            while len(keys) > SHARD_KEYS:  # the last run may go on
                yield out(SHARD_KEYS)
                keys, totals = keys[SHARD_KEYS:], totals[SHARD_KEYS:]
        if len(keys):
            yield out(len(keys))

    return _rows(partial).repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "shard long, keys binary, totals binary")


def _best(shards: DataFrame) -> np.ndarray:
    """The highest count of each B id: as many numbers as B has ids."""

    def run(batches):
        for batch in slices(batches):
            for k, n in zip(batch.column(0), batch.column(1), strict=True):
                k, n = np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64)
                b = k >> 32
                starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(b[starts]), pa.array(np.maximum.reduceat(n, starts))], names=["b", "n"])

    found = shards.select("keys", "totals").mapInArrow(run, "b long, n long").groupBy("b").agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(int(found["b"].to_numpy().max(initial=-1)) + 1, np.int64)
    best[found["b"].to_numpy()] = found["n"].to_numpy()
    return best


def _mapped(values: np.ndarray) -> np.ndarray:
    """values in a file of the task that is gone when it is closed, memory-mapped."""
    with tempfile.TemporaryFile() as f:
        values.tofile(f)
        f.flush()
        return np.memmap(f, values.dtype, "r", shape=values.shape)


def _answers(partial: DataFrame, shards: DataFrame) -> DataFrame:
    """(slice_, keys, totals): the corpus's counts of each slice's keys, a row for each shard that has some.

    The driver knows the shards' first keys, one for SHARD_KEYS distinct pairs.
    """
    firsts = np.sort(shards.select("shard").toArrow()["shard"].to_numpy())
    copies = max(1, -(-partial.count() // ASKING))

    def ask(batches):
        for batch in slices(batches):
            for s, k in zip(batch.column(0), batch.column(1), strict=True):
                k = np.frombuffer(k.as_buffer(), np.int64)
                of = np.searchsorted(firsts, k, "right") - 1
                starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                blobs = [x.tobytes() for x in np.split(k, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(firsts[of[starts]]), pa.array([s.as_py()] * len(starts), pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "slice_", "keys"])

    def answer(shard, asked):
        keys, totals = (_mapped(np.frombuffer(shard[c][0].as_buffer(), np.int64)) for c in ("keys", "totals"))
        found = [totals[np.searchsorted(keys, np.frombuffer(k.as_buffer(), np.int64))].tobytes() for k in asked["keys"]]
        return pa.table({"slice_": asked["slice_"], "keys": asked["keys"], "totals": pa.array(found, pa.binary())})

    copy = F.pmod(F.xxhash64("slice_"), F.lit(copies)).cast("int").alias("copy")
    asked = partial.select("slice_", "keys").mapInArrow(ask, "shard long, slice_ long, keys binary").select("shard", "slice_", "keys", copy)
    held = shards.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return held.groupBy("shard", "copy").cogroup(asked.groupBy("shard", "copy")).applyInArrow(lambda s, a: answer(s, a) if len(a) else pa.table({"slice_": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "totals": pa.array([], pa.binary())}), "slice_ long, keys binary, totals binary")


def pair_counts(docs: DataFrame, text: str = "text", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """(a, b, n): how many links of the corpus hold each pair of ids. Null and empty texts have none."""
    files = _files(docs, a_path, b_path)
    small = _small(files.value)
    shards = _shards(written(_partial(_encoded(docs, files, small, [], text, "groups", True), small)))

    def run(batches):
        for batch in slices(batches):
            for k, n in zip(batch.column(0), batch.column(1), strict=True):
                k, n = np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((k & _LOW).astype(np.int32)), pa.array((k >> 32).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

    return shards.select("keys", "totals").mapInArrow(run, "a int, b int, n long")


def align(docs: DataFrame, text: str = "text", keep: list[str] | None = None, a_path: str = A_PATH, b_path: str = B_PATH, groups: str = "groups", digest: bool = False) -> DataFrame:
    """Columns `keep` (None: all but the text) with n_a, n_b, n_groups, n_links, n_best, count_sum and the groups as `a1,a2|b1;a3|b2`.

    digest: the sha256 of the groups in their stead. n_best: links whose pair is as frequent in the corpus as any of its B id; count_sum: the pairs' counts
    over the links. A null or empty text, or one that the tokens don't give back byte by byte, has no tokens: zeros and ''. Repeated rows count as often
    as they are there. One row out for each row in; columns of `keep` with the new names are replaced. A text of any length is encoded whole.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", groups, "n_best", "count_sum", "slice_", "keys_", "times_"]
    keep = [c for c in ([x for x in docs.columns if x != text] if keep is None else keep) if c not in new]
    files = _files(docs, a_path, b_path)
    small = _small(files.value)
    encoded = written(_encoded(docs, files, small, keep, text, groups, digest))
    partial = written(_partial(encoded, small))
    shards = written(_shards(partial))
    best = docs.sparkSession.sparkContext.broadcast(_best(shards))
    answers = written(_answers(partial, shards))
    drop_written(partial, shards)
    shown = encoded.drop("slice_", "keys_", "times_").schema
    schema = T.StructType([*shown.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def finish(rows, known):
        """The documents of a slice with the counts of its keys."""
        n = np.array([len(x.as_buffer()) // 4 for x in rows["times_"]], np.int64)
        keys = np.concatenate([np.empty(0, np.int64), *(_keys(x.as_buffer(), small) for x in rows["keys_"])])
        times = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(x.as_buffer(), np.uint32) for x in rows["times_"])]).astype(np.int64)
        at = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in known["keys"])])
        total = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in known["totals"])])
        order = np.argsort(at, kind="stable")
        got = total[order][np.searchsorted(at[order], keys)] if len(keys) else keys
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(n)])])
        hit = got == best.value[keys >> 32] if len(keys) else keys.astype(bool)
        out = rows.drop_columns(["slice_", "keys_", "times_"])
        return out.append_column("n_best", pa.array(sums(times * hit))).append_column("count_sum", pa.array(sums(times * got)))

    return encoded.groupBy("slice_").cogroup(answers.groupBy("slice_")).applyInArrow(finish, schema)
