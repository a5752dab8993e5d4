r"""Chat formatting by event sourcing: an event log is folded into final messages, which are rendered with a loss mask.

Events are rows (conv_id, message, seq, kind, role, text). `message` orders the messages of a conversation and `seq` the
events of a message. Kinds: `open` starts a message with a role and a first text, `delta` appends, `edit` replaces the
text, `regenerate` throws away what was streamed so far, `retract` withdraws the message.

Template, one block per message: `### Role: text</turn>\n`. Control strings inside texts and roles are escaped with a
backslash, and so is the backslash, so that `parse_block` gives back role and text exactly.

Rows are sorted by Spark and streamed through the tasks; memory holds one message, however long a conversation is.
Folding and rendering run by (conversation, message), so a hot conversation is spread. Only the digest of a whole
conversation is sequential by its definition and streams through one task.

Defined results: null texts and deltas are empty, a null role is rendered as an empty one, null conversations form one
conversation, null messages come first; ties in `seq` go by kind, role and text; repeated rows are separate messages
where the caller gives them separate `message` values; an event of unknown kind fails; empty logs give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import slices

# The template.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
TRAINED_ROLES = ("assistant",)

_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
_CONTROL = re.compile(r"\\|#(?=## )|<(?=/turn>)")
_ROLE_CONTROL = re.compile(r"[\\#<:]")


def escape(text: str, pattern: re.Pattern = _CONTROL) -> str:
    return pattern.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def render_block(role: str, text: str) -> tuple[str, int, int]:
    """The block of a message, and start and length of its text under the loss mask (0, 0 if it does not train)."""
    head = HEAD + escape(role, _ROLE_CONTROL) + COLON
    body = escape(text)
    return head + body + END, *((len(head), len(body)) if role in TRAINED_ROLES else (0, 0))


def parse_block(block: str) -> tuple[str, str]:
    if not block.startswith(HEAD) or not block.endswith(END):
        raise ValueError("not a rendered turn")
    role, _, body = block[len(HEAD):-len(END)].partition(COLON)
    return unescape(role), unescape(body)


def fold(kind: str, text: str, held: str | None) -> str | None:
    if kind == "open":
        return text
    if kind == "delta":
        return (held or "") + text
    if kind == "edit":
        return text
    if kind == "regenerate":
        return ""
    if kind == "retract":
        return None
    raise ValueError(f"unknown event kind {kind!r}")



def render_turns(events: DataFrame, *order: str) -> DataFrame:
    """Rendered blocks, one per message that is left: (conv_id, *order, role, block, loss_start, loss_length).

    `order` are the columns that identify and order the messages of a conversation (default `message`).
    """
    order = order or ("message",)
    keys = ["conv_id", *order]
    schema = events.select(*keys).schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    out_schema = f"{ddl}, role string, block string, loss_start int, loss_length int"
    ready = (events.select(*keys, "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
             .repartition(*keys).sortWithinPartitions(*keys, "seq", "kind", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "role", "block", "loss_start", "loss_length"]
        at, role, parts, out = None, "", None, []

        def close():
            if at is not None and parts is not None:
                out.append((*at[0], role, *render_block(role, "".join(parts))))

        def flush():
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows) if rows else [[] for _ in names])), schema=arrow)

        for batch in slices(batches, 1024):
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *key, seq, kind, event_role, text in zip(*cols):
                if at is None or at[0] != tuple(key):
                    close()
                    at, role, parts = (tuple(key),), event_role, None
                if kind == "open":
                    role = event_role
                if kind == "delta" and parts is not None:
                    parts.append(text)
                else:
                    held = fold(kind, text, None if parts is None else "".join(parts))
                    parts = None if held is None else [held]
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(out_schema))
    return ready.mapInArrow(run, out_schema)


def read_back(turns: DataFrame, *order: str) -> DataFrame:
    """Digests per conversation, read back from the rendered blocks in order."""
    order = order or ("message",)
    ready = (turns.select("conv_id", *order, "block", "loss_start", "loss_length")
             .repartition("conv_id").sortWithinPartitions("conv_id", *order, "block"))
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state = object(), None

        def result():
            cid, n, turns_hash, chars, loss_hash, total = state
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([cid], pa.int64()), "n_turns": [n], "turns_sha256": [turns_hash.hexdigest()],
                                               "loss_chars": [chars], "loss_sha256": [loss_hash.hexdigest()], "formatted_chars": [total]})

        for batch in slices(batches, 1024):
            for cid, block, start, length in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "block", "loss_start", "loss_length"))):
                if state is None or cid != open_id:
                    if state is not None:
                        yield result()
                    open_id, state = cid, [cid, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_block(block)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role in TRAINED_ROLES:
                    trained = unescape(block[start:start + length])
                    state[3] += len(trained)
                    state[4].update(trained.encode("utf-8", "surrogatepass"))
                state[5] += len(block)
        if state is not None:
            yield result()

    return ready.mapInArrow(run, schema)


def conversations_of(turns: DataFrame, *order: str) -> DataFrame:
    """Whole rendered conversations as one string each, for callers whose conversations fit a row."""
    order = order or ("message",)
    rows = F.array_sort(F.collect_list(F.struct(*order, "block")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["block"]), "").alias("formatted"))


def log_of(rows: DataFrame, piece: int = 512) -> DataFrame:
    """The event log of a plain table (conv_id, turn, role, text): each row opens a message and streams its text.

    An assistant's message is streamed as a draft first and then regenerated, so that the fold has to take it back.
    The order of equal turns is by role, text and place in the input.
    """
    body = F.coalesce("text", F.lit(""))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.char_length(body) - 1 + F.lit(piece)) / piece).cast("int") - 1),
                         lambda i: F.struct((i + 4).alias("seq"), F.lit("delta").alias("kind"), F.substring(body, i * piece + 1, F.lit(piece)).alias("text")))
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    empty = F.lit("")
    draft = F.array(event(1, "delta", F.substring(body, 1, 16)), event(2, "regenerate", empty))
    events = F.concat(F.array(event(0, "open", empty)), F.when(F.col("role") == "assistant", draft).otherwise(F.slice(draft, 1, 0)),
                      F.when(body == "", F.slice(chunks, 1, 0)).otherwise(chunks))
    numbered = rows.select("conv_id", "turn", "role", "text", F.sha2(body, 256).alias("tie"), F.monotonically_increasing_id().alias("copy"))
    return (numbered.select("conv_id", "turn", "role", "tie", "copy", F.explode(events).alias("e"))
            .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("by_role"), "tie", "copy", "e.seq", "e.kind", "role", "e.text"))


ORDER = ("turn", "by_role", "tie", "copy")
