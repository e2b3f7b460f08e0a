"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

For every prefix of a text the last token of its encoding is unique. The table of last tokens is
filled from left to right: an Aho-Corasick automaton gives the vocabulary pieces that end at a
position, and the one whose predecessor (the table's entry where it starts) is pair-compatible,
i.e. the two stay apart when their joint text is merged, is that position's entry. The ids are
then recovered backwards from the end.

A merge never crosses from a character into a following space mark, as no piece of such a
vocabulary has a mark after another character (checked when the vocabulary is read), and
characters outside the vocabulary never merge. So texts are encoded word by word, each distinct
word once per worker while a bounded table of words lasts; the whole text is always encoded.

Defined cases: null text counts as empty; an empty text has only the end id; extra columns are
ignored by the digest; repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import small_batches

MARK = "▁"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_KEPT_BYTES, _LONG_WORD = 224 << 20, 64  # about what the table of words may take; longer words aren't kept
_PAIRS_KEPT = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """What a BPE model file says: mergeable pieces with scores, byte ids, end id."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    end_id: int

    @staticmethod
    def read(model_path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        byte_ids, pieces = [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((piece, i, model.get_score(i)))
                if re.search(f"[^{MARK}]{MARK}", piece):
                    raise ValueError(f"piece {piece!r} has a space mark after another character")
        probe = "Ａ① e\u0301 ﬁ x\tЀ "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model changes characters before it encodes them")
        return Vocabulary(tuple(pieces), tuple(byte_ids), model.eos_id())


class Codec:
    """Encodes and decodes in a worker; every table in it has a bound."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.score = {piece: score for piece, _, score in vocabulary.pieces}
        self.decimal_of = {piece: str(i) for piece, i, _ in vocabulary.pieces}
        self.byte_ids = vocabulary.byte_ids
        self.end_id = vocabulary.end_id
        self.byte_of = {str(i): b for b, i in enumerate(vocabulary.byte_ids)}
        # A byte below 128 is a character by itself; longer sequences are put together on a slower way.
        self.text_of = {str(i): piece.replace(MARK, " ") for piece, i, _ in vocabulary.pieces} | {i: chr(b) for i, b in self.byte_of.items() if b < 128} | {str(self.end_id): ""}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.splits: dict[str, tuple[str, str]] = {}
        self.right_spines: dict[str, list[tuple[str, float]]] = {}
        self.left_spines: dict[str, list[tuple[str, float]]] = {}
        self.words = _Words(self.decimal)
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.alphabet = {p for p in self.score if len(p) == 1}
        known = "".join(map(re.escape, sorted(self.alphabet)))
        self.stretches = re.compile(f"[{known}]+|[^{known}]+").findall

    def merged(self, text: str, last: bool = False) -> list[str]:
        """Merge step by step, best score first and leftmost among equals: only for pieces and pairs.

        last: give the two parts of the last merge instead.
        """
        parts: list[str | None] = list(text)
        split: tuple[str, str] = ("", "")
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (score := self.score.get(joint := parts[i] + parts[j])) is not None:
                heapq.heappush(agenda, (-score, i, j, joint))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, joint = heapq.heappop(agenda)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != joint:
                continue
            split = (parts[i], parts[j])
            parts[i], parts[j], after[i] = joint, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return split if last else [p for p in parts if p is not None]

    def spine(self, piece: str, right: bool) -> list[tuple[str, float]]:
        """The parts that stand at an end of the piece while it is merged, each with the score that ends it."""
        out, split = [(piece, -inf)], self.split(piece)
        while split:
            piece, split = split[right], (self.score[piece], self.split(split[right]))
            out.append((piece, split[0]))
            split = split[1]
        return out[::-1]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts of the piece's last merge."""
        if len(piece) == 1:
            return None
        if piece not in self.splits:
            self.splits[piece] = self.merged(piece, last=True)
        return self.splits[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart where they meet.

        Both grow from single characters; at each moment the parts at the seam could join each
        other or their own sides, and the better score goes first, the left one among equals.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= _PAIRS_KEPT:
                self.pairs.clear()
            if left[-1] == MARK and right[0] == MARK:  # runs of marks share one score
                known = self.merged(left + right) == [left, right]
            else:
                known = self.apart(left, right)
            self.pairs[left, right] = known
        return known

    def apart(self, left: str, right: str) -> bool:
        for piece, side, at in ((left, self.right_spines, True), (right, self.left_spines, False)):
            if piece not in side:
                side[piece] = self.spine(piece, at)
        a, b, score = self.right_spines[left], self.left_spines[right], self.score
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            joint = score.get(x + y)
            if joint is not None and joint > x_ends and joint >= y_ends:
                return False
            if x_ends == -inf and y_ends == -inf:
                return True
            if x_ends >= y_ends:
                i += 1
            else:
                j += 1

    def last_tokens(self, text: str) -> list[str | None]:
        """For every prefix length of a text of known characters the unique last token."""
        table: list[str | None] = [None] * len(text)
        pairs = self.pairs
        for end, piece in self.automaton.iter(text):
            if table[end] is None:
                start = end - len(piece)
                if start < 0:
                    table[end] = piece
                else:
                    left = table[start]
                    if left is not None and ((ok := pairs.get((left, piece))) or ok is None and self.compatible(left, piece)):
                        table[end] = piece
        return table

    def decimal(self, text: str) -> str:
        """Decimal ids of a stretch that starts with a space mark; unknown characters fall back to bytes."""
        out: list[str] = []
        for part in self.stretches(text):
            if part[0] in self.alphabet:
                table, found, end = self.last_tokens(part), [], len(part)
                while end:
                    piece = table[end - 1]
                    found.append(piece)
                    end -= len(piece)
                found.reverse()
                out += map(self.decimal_of.__getitem__, found)
            else:
                out += (str(self.byte_ids[b]) for c in part for b in c.encode("utf-8", "replace"))
        return " ".join(out)

    def encoded(self, text: str) -> str:
        """Decimal ids of a whole text with the end id."""
        if not text:
            return str(self.end_id)
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            found = [self.decimal(w) for w in _WORD.findall(MARK + text.replace(" ", MARK))]
        else:
            found = list(map(self.words.__getitem__, text.split(" ")))
        found.append(str(self.end_id))
        return " ".join(found)

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encoded(text).split(" ")))

    def decoded(self, ids: str) -> str:
        """The text of decimal ids; bytes that aren't UTF-8 become U+FFFD each."""
        found = ids.split(" ") if ids else []
        try:
            text = "".join(map(self.text_of.__getitem__, found))
        except KeyError:
            text = self.decoded_bytes(found)
        return text[1:] if text[:1] == " " else text

    def decoded_bytes(self, found: list[str]) -> str:
        out, raw = [], bytearray()
        for i in found:
            if (byte := self.byte_of.get(i)) is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(lenient(bytes(raw)))
                raw.clear()
            out.append(self.text_of.get(i, ""))
        return "".join(out) + lenient(bytes(raw))

    def decode(self, ids: list[int]) -> str:
        return self.decoded(" ".join(map(str, ids)))


class _Words(dict):
    """Ids of the words met so far, within a bound of memory; their space mark is left out."""

    def __init__(self, decimal, most: int = _KEPT_BYTES):
        self.decimal, self.most, self.used = decimal, most, 0

    def __missing__(self, word: str) -> str:
        found = self.decimal(MARK + word)
        if len(word) <= _LONG_WORD:
            if self.used >= self.most:
                self.clear()
                self.used = 0
            self[word] = found
            self.used += 200 + 4 * len(word) + len(found)
        return found


def lenient(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_WORD = re.compile(f"{MARK}+[^{MARK}]*")
_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    if shared.value not in _codecs:
        _codecs.clear()
        _codecs[shared.value] = Codec(shared.value)
    return _codecs[shared.value]


def sentencepiece_encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """The input with a column ``ids array<int>``: the encoding of each whole text, end id included."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model_path))  # one model file, whatever the input

    @F.pandas_udf("array<int>")
    def ids(texts):
        codec = _codec(shared)
        return texts.map(lambda t: codec.encode(t or ""))

    return docs.withColumn("ids", ids(F.coalesce(F.col(text), F.lit(""))))


def sentencepiece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; ids stay inside the tasks."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = codec.encoded(text.as_py() or "")
                counts.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decoded(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGESTS)
