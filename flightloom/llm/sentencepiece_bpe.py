"""SentencePiece merge-type (BPE) encoding and decoding through a prefix table.

Whether a sequence of pieces is the encoding of its text depends on adjacent
pairs only: each pair must be what its two pieces' text alone encodes to.  So
each prefix of a text has one last piece: among the pieces that an automaton
finds to end there, the one that is compatible with the last piece of the text
before it.  The table of last pieces is filled from left to right and the ids
are read from it backwards.

Merges never cross two adjacent characters that no piece holds side by side, so
texts are cut there first, and encodings of recurring cuts are kept.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, table

#: The visible space of SentencePiece.
SPACE = "▁"

#: Cuts whose encodings a Python worker keeps, and the longest cut that is kept.
KEPT_CUTS, KEPT_CHARS = 400_000, 48

#: Pairs whose compatibility is kept, about 60 MB; beyond that the table starts anew.
KEPT_PAIRS = 500_000


class PieceModel:
    """A merge-type model: vocabulary, prefix table, decoder.

    Models with user-defined or unused pieces, or with a normaliser that changes
    texts, are refused: they need more rules than merges."""

    def __init__(self, proto: bytes, most_kept: int = KEPT_CUTS):
        self.most_kept = most_kept
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.control = {i for i in range(len(self.pieces)) if sp.is_control(i) or sp.is_unknown(i)}
        byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in byte.items()}
        #: What pieces that are neither control ids nor bytes decode to.
        self.plain = {i: p.replace(SPACE, " ") for i, p in enumerate(self.pieces) if i not in self.control and i not in self.byte_of}
        self.bytes = byte
        normal = [i for i in range(len(self.pieces)) if i not in self.control and i not in self.byte_of]
        if any(sp.is_unused(i) for i in normal) or len(byte) != 256:
            raise ValueError("not a merge-type model with byte fallback")
        if sp.decode(sp.encode(" a  ﬁ ")) != " a  ﬁ ":
            raise ValueError("a model whose normaliser changes texts is not supported")
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in normal}
        chars = {c for p in self.ids for c in p}
        # characters that pieces hold but that are no piece themselves are numbered after the vocabulary
        self.extra = [c for c in sorted(chars) if c not in self.ids]
        self.names = self.pieces + self.extra
        self.lengths = [len(n) for n in self.names]
        tokens = dict(self.ids) | {c: len(self.pieces) + k for k, c in enumerate(self.extra)}
        self.automaton = ahocorasick.Automaton()
        self._spines: dict[int, tuple[list, list]] = {}
        for p, i in tokens.items():
            if self._spine(i):
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.chars = chars
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        loose = "".join(re.escape(c) for c in "\n\r\t" if c not in chars)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        runs = f"[^{loose}]+" if inner else f"{SPACE}*[^{SPACE}{loose}]+|{SPACE}+"
        self.cuts = re.compile(f"{runs}|[{loose}]+" if loose else (".+" if inner else runs), re.S)
        self._pairs: dict[int, bool] = {}
        self._kept: dict[str, tuple[bytes, str]] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding by its definition: merge the best-scored pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int) -> bool:
        """Merges a token's own text and notes when its outermost parts are consumed; False if the text does not merge to the token.

        A part's time is the lowest score among the merges that had to come first."""
        name = self.names[token]
        parts, made = list(name), [math.inf] * len(name)
        left, right = [], []
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return False
            time = min(best, made[at], made[at + 1])
            if at == 0:
                left.append((parts[0], time))
            if at == len(parts) - 2:
                right.append((parts[-1], time))
            parts[at : at + 2], made[at : at + 2] = [parts[at] + parts[at + 1]], [time]
        self._spines[token] = left + [(name, -math.inf)], right + [(name, -math.inf)]
        return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether the texts of two pieces, side by side, encode to these two pieces: no merge crosses their border.

        The outer parts of both sides grow by their own merges in time; a merge
        across the border happens if its score comes before both sides' next one
        (of equals the leftmost goes first)."""
        ours, theirs = self._spines[left][1], self._spines[right][0]
        i = j = 0
        while True:
            a, until_a = ours[i]
            b, until_b = theirs[j]
            across = self.scores.get(a + b)
            if across is not None and across > until_a and across >= until_b:
                return False
            if until_a == until_b == -math.inf:
                return True
            if until_a >= until_b:
                i += 1
            else:
                j += 1

    def prefix_table(self, text: str) -> list[int]:
        """The last piece of each prefix of a text of known characters (entry 0: -1)."""
        last = [-1] * (len(text) + 1)
        pairs = self._pairs
        if len(pairs) >= KEPT_PAIRS:
            pairs.clear()
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                left = last[end - size]
                if left >= 0:
                    key = left << 32 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self.compatible(left, token)
                    if fits:
                        last[end] = token
                elif end == size:
                    last[end] = token
        return last

    def _run(self, text: str) -> list[int]:
        """Ids of a text of known characters, recovered from the end of its prefix table."""
        last, j, out = self.prefix_table(text), len(text), []
        lengths, known = self.lengths, len(self.pieces)
        while j > 0:
            token = last[j]
            if token < known:
                out.append(token)
            else:
                out.extend(self.bytes[b] for b in reversed(self.names[token].encode()))
            j -= lengths[token]
        out.reverse()
        return out

    def _encoded(self, cut: str) -> tuple[bytes, str]:
        """Encodes a cut in parts that no merge can join: foreign characters, and runs that pieces can span."""
        coded, texts = [], []
        chars, beside, kept = self.chars, self.beside, self._kept
        lo, n = 0, len(cut)
        while lo < n:
            hi = lo + 1
            if cut[lo] in chars:
                while hi < n and cut[hi - 1 : hi + 1] in beside:
                    hi += 1
            else:
                while hi < n and cut[hi] not in chars:
                    hi += 1
            part = cut[lo:hi]
            value = kept.get(part)
            if value is None:
                ids = self._run(part) if part[0] in chars else [self.bytes[b] for b in part.encode()]
                value = array("i", ids).tobytes(), self._text(ids)
                self._keep(part, value)
            coded.append(value[0])
            texts.append(value[1])
            lo = hi
        if len(coded) == 1:
            return value
        value = b"".join(coded), "".join(texts)
        self._keep(cut, value)
        return value

    def _keep(self, cut: str, value: tuple[bytes, str]) -> None:
        if len(cut) <= KEPT_CHARS:
            if len(self._kept) >= self.most_kept:
                self._kept.clear()
            self._kept[cut] = value

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids with an end id as 32-bit numbers, the text that decode() makes of them)."""
        if not text:
            return np.array([self.eos], dtype=np.int32).tobytes(), ""
        kept, out = self._kept, []
        for cut in self.cuts.findall(SPACE + text.replace(" ", SPACE)):
            out.append(kept.get(cut) or self._encoded(cut))
        decoded = "".join([x[1] for x in out])
        return b"".join([x[0] for x in out] + [np.array([self.eos], dtype=np.int32).tobytes()]), decoded[1:]

    def _text(self, ids: list[int]) -> str:
        plain = self.plain
        try:
            return "".join([plain[i] for i in ids])
        except KeyError:
            pass
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(held))
                held = bytearray()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.pieces[i].replace(SPACE, " "))
        if held:
            out.append(_utf8(held))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: control ids vanish, bytes join into characters, the first piece loses its added space."""
        text = self._text(ids)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and first not in self.byte_of and self.pieces[first].startswith(SPACE) else text


def _utf8(held: bytearray) -> str:
    """Each byte that belongs to no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(held):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(held[at : at + size]).decode())
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


_models: dict[tuple[bytes, int], PieceModel] = {}


def piece_model(proto: bytes, most_kept: int = KEPT_CUTS) -> PieceModel:
    """One model a Python worker, with what it has kept."""
    if (proto, most_kept) not in _models:
        _models.clear()
        _models[proto, most_kept] = PieceModel(proto, most_kept)
    return _models[proto, most_kept]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, most_kept: int = KEPT_CUTS) -> DataFrame:
    """(id, ids, decoded): ids with an end id, and the text that they decode to.

    With `keep` those columns of `docs` come in place of the id.

    One row for each row of `docs`; a null or empty text has the end id alone.
    Ids may be null or repeat; an empty table gives an empty result; other
    columns are not looked at.  The model file is read once, on the driver, and
    sent to the executors (its size does not depend on the data).  most_kept: cuts
    whose encoding a Python worker keeps, about 250 bytes each; results do not
    depend on it."""
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(proto.value, most_kept)
        for batch in batches:
            at, last = 0, batch.num_columns - 1
            while at < batch.num_rows:
                ids, decoded, size, first = [], [], 0, at
                while at < batch.num_rows and size < 4_000_000:
                    text = batch.column(last)[at].as_py() or ""
                    coded, back = model.encode(text)
                    ids.append(coded)
                    decoded.append(back)
                    size += len(text)
                    at += 1
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                flat = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                kept = batch.slice(first, at - first).columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(decoded, pa.string())], names=[*batch.schema.names[:-1], "ids", "decoded"])

    columns = [c for c in keep if c not in ("ids", "decoded", "_whole_text")] if keep else [F.col(id_col).cast("long").alias("id")]
    picked = docs.select(*columns, F.col(text_col).cast("string").alias("_whole_text"))
    schema = picked.drop("_whole_text").schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return picked.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids (null: null)."""
    with open(model_path, "rb") as f:
        proto = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decoded(ids):  # noqa: ANN001, ANN202
        model = piece_model(proto.value)
        return ids.map(lambda x: None if x is None else model.decode([int(i) for i in x]))

    return df.withColumn(out_col, decoded(F.col(ids_col)))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
