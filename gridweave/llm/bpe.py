"""Operator 2: byte-pair encoding and decoding with a segment tree over pair ranks.

A text is cut into chunks (a run of ASCII white space and the word after it), equal chunks of an
Arrow batch are encoded once, and the merges of all new words run side by side in numpy: every word
has a segment tree whose leaves are the ranks of its adjacent pairs; the root is the leftmost pair of
the lowest rank; a merge changes three leaves and their paths to the root. This goes on until no root
holds a mergeable pair. Words of the same padded width share one array of trees.

Files whose normaliser, cutting or model settings are not those that this codec follows are refused.

Defined results: a null text counts as empty; an empty text has no ids; a very long text is handled alone, in
memory in proportion to it, and a very long word in steps of its length times the logarithm of it; repeated rows
give equal results each; an empty table gives no row; strings of added tokens become their ids; doc_id may be of
any type; extra columns of the input are ignored by the query and kept by ``with_tokens``, where those named like
a result are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Code points of Unicode's White_Space.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: How the two kinds of vocabulary cut a text before the merges (fixed by the vocabularies).
BYTE_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
END_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Words of letters, digits and ASCII marks that hold no added token and begin with no contraction.
PLAIN = r"[\pL\p{Nd}!-&(-;=-~][\pL\p{Nd}!-;=-~]*$"

SLICE_BYTES = 2 << 20  #: text handled at once by a task; a longer text is handled alone
CACHE_CHUNKS = 500_000  #: encoded chunks that a Python worker remembers
BATCH_ROWS = 1_000  #: rows of an Arrow batch
TREE_CELLS = 1 << 18  #: leaves of the trees that are merged at once
NEVER = np.iinfo(np.int64).max

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


#: What a file must say of itself, by its end-of-word suffix.
SETTINGS = {
    "": (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}),
    "</w>": (["NFC", "Replace", "Lowercase"], {"type": "Sequence", "pretokenizers": ["Split", "ByteLevel"]}),
}


def check_settings(spec: dict) -> None:
    """Raises if the file asks for anything that this codec does not do."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    suffix = model.get("end_of_word_suffix") or ""
    steps = None if spec.get("normalizer") is None else [n["type"] for n in spec["normalizer"].get("normalizers", [])]
    got = {k: [x["type"] for x in v] if k == "pretokenizers" else v for k, v in cut.items() if k != "trim_offsets"}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    flags = any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if model.get("type") != "BPE" or suffix not in SETTINGS or SETTINGS[suffix] != (steps, got) or not plain or flags:
        raise ValueError("this vocabulary file's normaliser, cutting or model settings are not supported")


def byte_names() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(plain)))
    return [names[b] for b in range(256)]


def ragged_take(off: np.ndarray, val: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``idx`` of the ragged array, as offsets and values."""
    start, size = off[idx], off[idx + 1] - off[idx]
    new = np.zeros(len(idx) + 1, np.int64)
    np.cumsum(size, out=new[1:])
    return new, val[np.repeat(start - new[:-1], size) + np.arange(new[-1])]


class PairTable:
    """Rank of a pair of symbols, by open addressing in numpy arrays."""

    def __init__(self, pairs: np.ndarray, made: np.ndarray):
        self.made, self.bits = made, 18
        while 1 << self.bits < 4 * len(pairs):
            self.bits += 1
        self.mask = (1 << self.bits) - 1
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, slot = np.arange(len(pairs)), self._slot(pairs)
        while len(left):
            free = self.keys[slot] < 0
            first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)[1]
            won = np.zeros(len(left), bool)
            won[first] = True
            won &= free
            self.keys[slot[won]], self.ranks[slot[won]] = pairs[left[won]], left[won]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        mixed = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no such merge."""
        pair = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(pair)
        seen = self.keys[slot]
        out = np.where(seen == pair, self.ranks[slot], -1)
        open_ = np.flatnonzero((seen != pair) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot[open_]]
            hit = seen == pair[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


def merge_block(sym: np.ndarray, size: np.ndarray, table: PairTable) -> np.ndarray:
    """Merges rows of ``sym`` (padded to a power of two) to the end; merged-away cells become -1."""
    n, width = sym.shape
    if width < 2 or not n:
        return sym
    bits = width.bit_length() - 1
    here = np.arange(width)
    nxt = np.broadcast_to(here + 1, (n, width)).copy()
    prv = np.broadcast_to(here - 1, (n, width)).copy()
    alive = here[None, :] < size[:, None]
    tree = np.full((n, 2 * width), NEVER, np.int64)
    r, c = np.nonzero(alive[:, 1:])
    rank = table.rank(sym[r, c], sym[r, c + 1])
    r, c, rank = r[rank >= 0], c[rank >= 0], rank[rank >= 0]
    tree[r, width + c] = (rank << bits) | c
    for level in range(bits - 1, -1, -1):
        lo = 1 << level
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    flat, s, nx_, pv_ = tree.reshape(-1), sym.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
    rows = np.flatnonzero(tree[:, 1] < NEVER)
    while len(rows):
        best = flat[rows * 2 * width + 1]
        rows, best = rows[best < NEVER], best[best < NEVER]
        if not len(rows):
            break
        base, top = rows * width, rows * 2 * width
        at = best & (width - 1)
        new = table.made[best >> bits]
        gone = nx_[base + at]
        after, before = nx_[base + gone], pv_[base + at]
        s[base + at], s[base + gone] = new, -1
        nx_[base + at] = after
        end = size[rows]
        tail = after < end
        pv_[(base + after)[tail]] = at[tail]
        flat[top + width + gone] = NEVER
        key = np.full(len(rows), NEVER, np.int64)
        rank = table.rank(new[tail], s[(base + after)[tail]])
        key[tail] = np.where(rank >= 0, (rank << bits) | at[tail], NEVER)
        flat[top + width + at] = key
        head = before >= 0
        rank = table.rank(s[(base + before)[head]], new[head])
        flat[(top + width + before)[head]] = np.where(rank >= 0, (rank << bits) | before[head], NEVER)
        paths = np.concatenate([width + at, width + gone, width + np.maximum(before, 0)])
        tops = np.concatenate([top, top, top])
        for _ in range(bits):
            paths >>= 1
            node = tops + 2 * paths
            flat[tops + paths] = np.minimum(flat[node], flat[node + 1])
    return sym


class BpeCodec:
    """Encoder and decoder for a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_settings(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = regex.compile(END_WORDS if self.suffix else BYTE_WORDS)
        # on plain chunks, a line each, the standard library's faster search finds the same words
        self.lines = re.compile(r"[^\W\d_]+|\n|'(?:s|t|re|ve|m|ll|d)|\d" + ("" if self.suffix else "+") + r"|(?:[^\w\s]|_)+")
        self.plain = (r"^[ \t-\r]*" if self.suffix else "^ ?") + PLAIN
        names = byte_names()
        self.first = np.array([self.vocab[c] for c in names], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in names], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(self.vocab[a] << 32) | self.vocab[b] for a, b in merges], np.int64)
        self.table = PairTable(pairs, np.array([self.vocab[a + b] for a, b in merges], np.int64))
        size = 1 + max([*self.vocab.values(), *self.added.values()])
        tokens = [""] * size
        for t, i in [*self.vocab.items(), *self.added.items()]:
            tokens[i] = t
        self.tokens = pa.array(tokens, pa.large_string())
        self.decimals = pa.array([str(i) for i in range(size)], pa.large_string())
        self.keys, self.off, self.val = pa.array([], pa.binary()), np.zeros(1, np.int64), np.zeros(0, np.int32)

    # -- words ---------------------------------------------------------------------------------
    def merge_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word (UTF-8, not empty), as offsets and values."""
        if not len(words):
            return np.zeros(1, np.int64), np.zeros(0, np.int32)
        words = pa.concat_arrays([words.cast(pa.large_binary())])
        start = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2], np.uint8)[start[0] : start[-1]]
        start = start - start[0]
        size = np.diff(start)
        sym = self.first[raw]
        sym[start[1:] - 1] = self.last[raw[start[1:] - 1]]
        width = 1 << np.maximum(0, np.ceil(np.log2(np.maximum(size, 1)))).astype(np.int64)
        out = np.full(len(sym), -1, np.int64)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            for i in range(0, len(rows), step := max(1, TREE_CELLS // int(w))):
                part = rows[i : i + step]
                cells = np.arange(w)[None, :]
                inside = cells < size[part][:, None]
                block = np.full((len(part), int(w)), -1, np.int64)
                block[inside] = sym[(start[part][:, None] + cells)[inside]]
                out[(start[part][:, None] + cells)[inside]] = merge_block(block, size[part], self.table)[inside]
        off = np.zeros(len(words) + 1, np.int64)
        off[1:] = np.cumsum(out >= 0)[start[1:] - 1]
        return off, out[out >= 0].astype(np.int32)

    def pieces(self, chunk: str) -> list[bytes | int]:
        """Words of a chunk, and ids of added tokens."""
        if self.split_added is not None and "<" in chunk and (parts := self.split_added.split(chunk))[1:]:
            return [x for p in parts for x in ([self.added[p]] if p in self.added else self.pieces(p) if p else [])]
        if self.suffix:
            chunk = self._normal(chunk)
        return [w.encode() for w in self.words.findall(chunk)]

    def plain_pieces(self, chunks: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Words of chunks that hold letters, digits and ASCII marks only, all found in one search.

        Returns the number of words of each chunk, the distinct words and the number of each word."""
        spaced = pc.starts_with(chunks, b" ").to_numpy(zero_copy_only=False)
        rows = pa.LargeListArray.from_arrays(pa.array([0, len(chunks)]), pc.ascii_ltrim_whitespace(chunks.cast(pa.large_string())))
        text = pc.binary_join(rows, pa.scalar("\n", pa.large_string()))[0].as_py() + "\n"
        if self.suffix:
            text = self._normal(text)
        found = pa.array(self.lines.findall(text))
        ends = pc.equal(found, "\n").to_numpy(zero_copy_only=False)
        words, edge = found.filter(pa.array(~ends)), np.flatnonzero(ends)
        edge = edge - np.arange(len(edge))
        count = np.diff(edge, prepend=0)
        if not self.suffix:
            lead = np.zeros(len(words), np.int64)
            lead[(edge - count)[spaced]] = 1
            words = pc.binary_join_element_wise(pa.array(["", " "]).take(pa.array(lead)), words, "")
        coded = words.dictionary_encode()
        return count, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def encode_new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk, as offsets and values."""
        plain = pc.match_substring_regex(chunks.cast(pa.string()), self.plain).to_numpy(zero_copy_only=False)
        easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)
        n_easy, words, which = self.plain_pieces(chunks.take(pa.array(easy))) if len(easy) else (np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64))
        number = {}
        rest: list[int] = []
        n_hard = np.zeros(len(hard), np.int64)
        for k, c in enumerate(chunks.take(pa.array(hard)).to_pylist()):
            got = self.pieces(c.decode())
            n_hard[k] = len(got)
            # added tokens are kept as -1 - id for now
            rest += [-1 - w if isinstance(w, int) else len(words) + number.setdefault(w, len(number)) for w in got]
        off, val = self.merge_words(pa.concat_arrays([words.cast(pa.large_binary()), pa.array(list(number), pa.large_binary())]))
        idx = np.concatenate([which, np.array(rest, np.int64)])
        if len(special := np.flatnonzero(idx < 0)):
            ids = -1 - idx[special]
            idx[special] = len(off) - 1 + np.arange(len(special))
            off, val = np.concatenate([off, off[-1] + 1 + np.arange(len(special))]), np.concatenate([val, ids.astype(np.int32)])
        out, ids = ragged_take(off, val, idx)
        edge = np.zeros(len(chunks) + 1, np.int64)
        np.cumsum(np.concatenate([n_easy, n_hard]), out=edge[1:])
        order = np.empty(len(chunks), np.int64)
        order[np.concatenate([easy, hard])] = np.arange(len(chunks))
        return ragged_take(out[edge], ids, order)

    # -- texts ---------------------------------------------------------------------------------
    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text, as offsets (a row more than texts) and values."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(1, np.int64), np.zeros(0, np.int32)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        begins = np.zeros(len(raw) + 1, bool)
        space = _WS[raw]
        begins[1:-1] = space[1:] & ~space[:-1]
        begins[at] = True
        begins[-1] = False
        edge = np.append(np.flatnonzero(begins), len(raw))
        if self.suffix == "":
            edge = self._joined_edges(raw, edge, at)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary()) if len(raw) else pa.array([], pa.binary())
        coded = chunks.dictionary_encode()
        inverse = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        off, val, place = self._known(coded.dictionary)
        out, ids = ragged_take(off, val, place[inverse])
        return out[np.searchsorted(edge, at)], ids

    @staticmethod
    def _joined_edges(raw: np.ndarray, edge: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Without the edges that cut a run of white space whose first part is not ASCII."""
        inner = edge[(edge > 0) & (edge < len(raw))]
        odd = inner[raw[inner - 1] >= 0x80]
        bad = [e for e in odd.tolist() if regex.search(rf"[{SPACE}]$", bytes(raw[max(0, e - 3) : e]).decode(errors="replace"))]
        return np.setdiff1d(edge, np.setdiff1d(bad, at)) if bad else edge

    def _known(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = pc.fill_null(pc.index_in(chunks, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return self.off, self.val, place
        fresh = chunks.take(pa.array(new))
        off, val = self.encode_new(fresh)
        place[new] = len(self.off) - 1 + np.arange(len(new))
        off, val = np.concatenate([self.off, self.off[-1] + off[1:]]), np.concatenate([self.val, val])
        if len(self.keys) + len(new) <= CACHE_CHUNKS:
            self.keys, self.off, self.val = pa.concat_arrays([self.keys, fresh]), off, val
        return off, val, place

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """What the library's decode() gives for each row: tokens joined by a space where the file names
        no decoder; the bytes behind the tokens, as UTF-8 with replacement characters, for byte-level files."""
        rows = pa.LargeListArray.from_arrays(pa.array(offsets), self.tokens.take(pa.array(ids)))
        if self.suffix:
            return pc.binary_join(rows, pa.scalar(" ", pa.large_string()))
        value = {c: b for b, c in enumerate(byte_names())}
        joined = pc.binary_join(rows, pa.scalar("", pa.large_string())).to_pylist()
        return pa.array([b"".join(bytes([value[c]]) if c in value else c.encode() for c in t).decode(errors="replace") for t in joined], pa.large_string())


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The codec of a file, kept with its cache for the life of a Python worker."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs of about SLICE_BYTES of text; a longer text makes a run alone."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        begin = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()):
            if have and have + size > SLICE_BYTES:
                held.append(batch.slice(begin, i - begin))
                yield pa.concat_batches([h for h in held if h.num_rows])
                held, have, begin = [], 0, i
            have += size
        held.append(batch.slice(begin))
        if len(held) > 64:  # many short texts
            held = [pa.concat_batches(held)]
    if any(h.num_rows for h in held):
        yield pa.concat_batches(held)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session's Arrow batches are held to a number of rows that suits long texts. The setting is read
    when the plan runs, so it stays set for the session's later queries, whose results it does not change."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def with_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids array<int>`` and ``decoded string`` (replacing columns of these names)."""
    docs = docs.drop("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slices(batches):
            off, ids = c.encode(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, c.decode(off, ids).cast(pa.string())], [*part.schema.names, "ids", "decoded"])

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return small_batches(docs).mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what ``with_tokens`` gives, taken in the
    same Arrow batch so that ids and decoded texts need not go back to the JVM."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slices(batches):
            off, ids = c.encode(part.column("text"))
            lists = pa.LargeListArray.from_arrays(pa.array(off), c.decimals.take(pa.array(ids)))
            written = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
            digest = lambda a: pa.array([sha256(x.as_buffer()).hexdigest() for x in a.cast(pa.large_binary())])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(off)), digest(written), digest(c.decode(off, ids))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)
