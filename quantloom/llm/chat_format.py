"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context and
only the reply is trainable. A conversation that doesn't end with an assistant turn also gives
one tail example without a trainable part, so that no turn is lost.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts a ``<``,
any number of backslashes and ``|`` gets one more backslash, so a control string never comes
from a text, and taking that backslash away restores the text exactly. Roles also escape
backslash and line feed.

Defined cases: null text and null role count as empty; a null conv_id is a conversation of its
own; null turns come first; rows with equal turns are ordered by role and text; repeated rows
are repeated turns; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import small_batches

START, END, TRAINED = "<|im_start|>", "<|im_end|>\n", "assistant"
EXAMPLES = "conv_id long, example int, text string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
_FLUSH_CHARS = 4_000_000
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def header(role: str) -> str:
    return START + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n"


def read_header(written: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], written))


def read_turns(example: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that an example was made from."""
    for turn in example.split(END)[:-1]:
        role, _, text = turn[len(START) :].partition("\n")
        yield read_header(role), unescape(text)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come conversation by conversation in turn order; only one prefix is held."""
    names = ["conv_id", "example", "text", "loss_start", "loss_end"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    out: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal out, held
        columns = zip(*out) if out else [[]] * 5
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)
        out, held = [], 0
        return batch

    conv, prefix, example, open_tail, begun = None, "", 0, False, False
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if not begun or conv_id != conv:
                if begun and open_tail:
                    out.append((conv, example, prefix, len(prefix), len(prefix)))
                    held += len(prefix)
                conv, prefix, example, begun = conv_id, "", 0, True
            opening, body = prefix + header(role or ""), escape(text or "")
            prefix = opening + body + END
            open_tail = role != TRAINED
            if not open_tail:
                out.append((conv, example, prefix, len(opening), len(opening) + len(body)))
                example, held = example + 1, held + len(prefix)
            if held >= _FLUSH_CHARS:
                yield flush()
    if begun and open_tail:
        out.append((conv, example, prefix, len(prefix), len(prefix)))
    if out:
        yield flush()


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn (and tail): conv_id, example, text, loss_start, loss_end.

    Partitions hold whole conversations in order, and tasks stream through them, so a very long
    conversation never sits in memory as a group.
    """
    small_batches(conversations)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_expand, EXAMPLES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the examples back; those of a conversation follow each other in order."""
    columns = [f.split(" ")[0] for f in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def closed() -> list:
        turns, n = hashlib.sha256(), 0
        for role, text in read_turns(last):
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            n += 1
        return [conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted, examples]

    conv, last, begun, loss, loss_chars, formatted, examples = None, "", False, hashlib.sha256(), 0, 0, 0
    for batch in batches:
        done = []
        for conv_id, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end"))):
            if not begun or conv_id != conv:
                if begun:
                    done.append(closed())
                conv, begun, loss, loss_chars, formatted, examples = conv_id, True, hashlib.sha256(), 0, 0, 0
            reply = unescape(text[start:end])
            loss.update(reply.encode("utf-8", "surrogatepass"))
            loss_chars, formatted, examples, last = loss_chars + len(reply), formatted + len(text), examples + 1, text
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], columns)
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(closed(), types)], columns)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, what the examples say about it; takes them as prefix_target_examples deals them out."""
    return examples.mapInArrow(_digest, DIGESTS)
