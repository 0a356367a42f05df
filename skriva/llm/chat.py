"""Chat formatting by schema fingerprints.

A record's fingerprint is a hash of its nested field paths (array items as []). It selects a declarative
mapping, which says where turns, roles and texts are; a layout is added by adding a mapping. Turns are
written in one template that marks each and escapes its control strings, and read back from it.

Null texts and roles are empty. A record with an unknown fingerprint has no turns and is reported by
canonical() with its fingerprint. Turns of a conversation stand by turn, null first, then by role and text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

OPEN, CLOSE = "### ", "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)

#: Layouts: either "each" (path of the list of turns, field of the role, field of the text) or "flat"
#: (pairs of a role and the fields whose non-empty texts, joined by blank lines, are its turn).
LAYOUTS: list[tuple[tuple[str, ...], dict]] = [
    (("conv_id", "role", "text", "turn"), {"each": ("", "role", "text")}),
    (("role", "text"), {"each": ("", "role", "text")}),
    (("content", "role"), {"each": ("", "role", "content")}),
    (("messages[].content", "messages[].role"), {"each": ("messages", "role", "content")}),
    (("conversations[].from", "conversations[].value"), {"each": ("conversations", "from", "value")}),
    (("dialog[].speaker", "dialog[].text"), {"each": ("dialog", "speaker", "text")}),
    (("prompt", "response"), {"flat": (("user", ("prompt",)), ("assistant", ("response",)))}),
    (("completion", "prompt"), {"flat": (("user", ("prompt",)), ("assistant", ("completion",)))}),
    (("prompt", "response", "system"), {"flat": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))}),
    (("instruction", "output"), {"flat": (("user", ("instruction",)), ("assistant", ("output",)))}),
    (("input", "instruction", "output"), {"flat": (("user", ("instruction", "input")), ("assistant", ("output",)))}),
    (("answer", "question"), {"flat": (("user", ("question",)), ("assistant", ("answer",)))}),
    (("answer", "context", "question"), {"flat": (("user", ("context", "question")), ("assistant", ("answer",)))}),
]
#: Other names of the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(value: object, at: str = "") -> Iterator[str]:
    """Field paths of a record; an empty list or object has only its own path."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from paths(v, f"{at}.{k}" if at else str(k))
    elif isinstance(value, list) and value:
        for v in value:
            yield from paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(fields: Iterator[str] | tuple[str, ...]) -> int:
    digest = hashlib.blake2b("\n".join(sorted(set(fields))).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


MAPPINGS = {fingerprint(fields): mapping for fields, mapping in LAYOUTS}


def turns(record: dict, known: dict[int, dict] | None = None) -> tuple[int, list[tuple[str, str]] | None]:
    """(fingerprint, [(role, text)] or None if no mapping has that fingerprint)."""
    print_ = fingerprint(paths(record))
    mapping = (MAPPINGS if known is None else known).get(print_)
    if mapping is None:
        return print_, None
    if "flat" in mapping:
        joined = ((role, "\n\n".join(t for f in fields if (t := text_of(record.get(f))))) for role, fields in mapping["flat"])
        return print_, [(role, t) for role, t in joined if t or role != "system"]
    top, role, text = mapping["each"]
    items = [record] if not top else record.get(top) or []
    return print_, [(ROLES.get(r := text_of(x.get(role)), r), text_of(x.get(text))) for x in items]


def text_of(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\#\\#\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """The turn as written, and where in it the loss mask is: an assistant's text, else nowhere."""
    head = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return f"{head}{body}{CLOSE}", (len(head), len(head) + len(body)) if role == "assistant" else None


def parse(formatted: str) -> list[tuple[str, str]]:
    """[(role, text)] of what was written; raises where that isn't a run of turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn begins at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def canonical(records: DataFrame) -> DataFrame:
    """From (id, pos, json): id, pos, part, role, text of each turn, or fingerprint alone where no mapping fits."""

    def rows(batches):
        for b in batches:
            out = []
            for key, pos, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                print_, made = turns(json.loads(text) if text else {})
                out += [(key, pos, None, None, None, print_)] if made is None else [(key, pos, i, r, t, print_) for i, (r, t) in enumerate(made)]
            if out:
                yield shared.as_batch(["id", "pos", "part", "role", "text", "fingerprint"], list(zip(*out, strict=True)), [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()])

    return shared.arrow(records.select("id", "pos", "json"), rows, "id long, pos long, part int, role string, text string, fingerprint long")


def formatted(canonical_turns: DataFrame) -> DataFrame:
    """id, pos, part, piece and loss (start, end in the piece) of each turn; a conversation is its pieces in order.

    At scale: rows are dealt by id and sorted there; a piece is made from its turn alone, so a conversation
    of any length passes through a task as a stream.
    """

    def rows(batches):
        for b in batches:
            made = [format_turn(r or "", t or "") for r, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield shared.as_batch(
                ["id", "pos", "part", "piece", "loss_start", "loss_end"],
                [b.column(0), b.column(1), b.column(2), [p for p, _ in made], [s and s[0] for _, s in made], [s and s[1] for _, s in made]],
                [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()],
            )

    have = canonical_turns.filter("part is not null").repartition("id")
    in_order = have.sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("pos").asc_nulls_first(), "part", "role", "text")
    return shared.arrow(in_order.select("id", "pos", "part", "role", "text"), rows, "id long, pos long, part int, piece string, loss_start int, loss_end int")


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from formatted()."""

    def rows(batches):
        key, state, out = None, None, []

        def close():
            if state:
                out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for i, piece, start, end in zip(b.column(0).to_pylist(), *(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                if state is None or i != key:
                    close()
                    key, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    under = unescape(piece[start:end])
                    state[2] += len(under)
                    state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if out:
                yield shared.as_batch(names, list(zip(*out, strict=True)), kinds)
                out.clear()
        close()
        if out:
            yield shared.as_batch(names, list(zip(*out, strict=True)), kinds)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return shared.arrow(pieces, rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def messages(conversations: DataFrame) -> DataFrame:
    """Rows of one message each as records (id, pos, json), in a layout that the conversation's id chooses.

    The layouts are those of sources that meet in one corpus: flat messages with text or content, and a list of
    one message under messages or under conversations. Each comes back by its own fingerprint.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text")]
    one = lambda role, said: F.struct(F.col("role").alias(role), F.col("text").alias(said))
    flat = F.struct(F.coalesce(F.col("conv_id"), F.lit(0)).alias("conv_id"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), F.col("role"), F.col("text"))
    layouts = [flat, one("role", "content"), F.struct(F.array(one("role", "content")).alias("messages")), F.struct(F.array(one("from", "value")).alias("conversations"))]
    which = F.pmod(F.xxhash64("conv_id"), F.lit(len(layouts)))
    record = F.to_json(layouts[0])
    for i, layout in enumerate(layouts[1:], 1):
        record = F.when(which == i, F.to_json(layout)).otherwise(record)
    return conversations.select(*own).select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), record.alias("json"))
