"""Chat formatting: conversations rendered through a compiled template, with the spans that a model is to learn, and read back.

Rows are range-sorted by (conv_id, turn), so that a conversation that holds most rows is spread over many
tasks. A first pass numbers the turns within each partition; one row a partition (its first and last
conversation and their turns) tells where a conversation goes on, and a second pass renders turn by turn
and writes segments: stretches of one conversation's text of about ``SEGMENT`` code points, cut between turns. The
formatted conversation is its segments in order. Reading back works segment by segment; a conversation of
one segment is done there, the parts of a longer one are digested in order by one task that reads them as
a stream (a SHA-256 can't be computed in parts), without their template or parsing.

The template marks turns by control strings. A text is escaped so that it holds none: a control string gets
a backslash after its first character, one that already has backslashes there one more; taking one away
restores the text exactly. Roles are escaped too, with their line ends.

Defined results: null text and null role are empty; null turns come first in their conversation, rows with
the same turn go by role and text; rows with null conv_id are one conversation; repeated rows are turns of
their own; a conversation without assistant rows has an empty loss text; an empty table gives no rows; extra
columns take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.template import Template, joined
from quern.llm.work import save

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
#: A control string, or one with backslashes after its first character.
_HIDDEN = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in CONTROLS))
#: Code points after which a segment ends with its turn.
SEGMENT = 1 << 20

#: The turns of others stand between [INST] and [/INST] after their role, an assistant's end with </s>.
TEMPLATE = r"""{% set answering = 'assistant' -%}
<s>
{%- for m in messages -%}
{%- if m.role == answering -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}</s>
{%- else -%}
[INST]{{ m.role | line | escape }}{{ '\n' }}{{ m.text | escape }}[/INST]
{%- endif -%}
{%- endfor -%}
"""


def _around(m: re.Match) -> tuple[str, str, str]:
    return next((m[i], m[i + 1], m[i + 2]) for i in range(1, 3 * len(CONTROLS), 3) if m[i] is not None)


def escape(text: str) -> str:
    def hide(m: re.Match) -> str:
        first, slashes, rest = _around(m)
        return f"{first}{slashes}\\{rest}"

    return _HIDDEN.sub(hide, text)


def unescape(text: str) -> str:
    def show(m: re.Match) -> str:
        first, slashes, rest = _around(m)
        return f"{first}{slashes[1:]}{rest}"

    return _HIDDEN.sub(show, text)


def line(text: str) -> str:
    """A text without line ends."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable] = {"escape": escape, "line": line}


def compiled(source: str = TEMPLATE) -> Template:
    """A template that can be rendered turn by turn."""
    t = Template(source, FILTERS)
    if not t.streams:
        raise ValueError("the template must read messages in one loop only, at its top level")
    return t


def read_turns(text: str) -> Iterator[tuple[str, str, int]]:
    """(role, escaped text, its place) of each turn of a formatted conversation or segment."""
    at = len("<s>") if text.startswith("<s>") else 0
    while at < len(text):
        if text.startswith("[INST]", at):
            end = text.index("[/INST]", at)
            turn = text.index("\n", at)
            yield unline(unescape(text[at + len("[INST]") : turn])), text[turn + 1 : end], turn + 1
            at = end + len("[/INST]")
        else:
            end = text.index("</s>", at)
            yield "assistant", text[at:end], at
            at = end + len("</s>")


def ordered(df: DataFrame) -> DataFrame:
    """conv_id, role, text, part, k, first, last: turns in order, in partitions that follow each other.

    ``k``: the turn's number among its conversation's in the partition; ``first``, ``last``: whether it stands in the
    partition's first conversation, and whether it is its conversation's last there.
    """
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    start = F.substring("text", 1, 256)  # the sampled bounds hold no whole texts
    rows = rows.repartitionByRange("conv_id", "turn", "role", start).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, k, first = TaskContext.get().partitionId(), None, -1, True
        held = None  # the last row so far, as the next one tells whether its conversation ends

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return _batch(rows, types, names)

        types, names = None, ["conv_id", "role", "text", "part", "k", "first", "last"]
        for b in batches:
            types = [b.schema.field("conv_id").type, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new = held is None or row[0] != conv
                first = first and (held is None or not new)
                if held is not None:
                    out.append((*held, new))
                k, conv = 0 if new else k + 1, row[0]
                held = (*row, part, k, first)
            if out:
                yield sent(out)
        if held is not None:
            yield sent([(*held, True)])

    kind = df.schema["conv_id"].dataType.simpleString()
    return save(rows.mapInArrow(number, f"conv_id {kind}, role string, text string, part int, k bigint, first boolean, last boolean"), "turns")


def carried(turns: DataFrame) -> dict[int, tuple[int, object, bool]]:
    """Of each partition: the turns that its first conversation has before it, its last conversation, and whether that goes on after it.

    One row a partition comes to the driver.
    """
    ends = turns.where("last").groupBy("part").agg(F.max(F.when(F.col("first"), F.struct("k", "conv_id"))).alias("a"), F.max(F.struct("conv_id", "k")).alias("b"))
    rows = sorted((r["part"], r["a"]["conv_id"], r["a"]["k"] + 1, r["b"]["conv_id"], r["b"]["k"] + 1) for r in ends.collect())
    out, run, before = {}, 0, object()
    for i, (part, head, n_head, tail, n_tail) in enumerate(rows):
        since = run if head == before else 0
        out[part] = (since, tail, i + 1 < len(rows) and rows[i + 1][1] == tail)
        run, before = since + n_head if head == tail else n_tail, tail
    return out


SEGMENTS = "conv_id {}, at bigint, n bigint, opens boolean, closes boolean, text string, spans array<struct<start:bigint,end:bigint>>"


def formatted(df: DataFrame, source: str = TEMPLATE, segment: int = SEGMENT) -> DataFrame:
    """Segments of each conversation's formatted text: conv_id, at (its first turn's number), n (turns), opens, closes, text, spans.

    ``spans``: what is under the loss mask, in code points of the segment.
    """
    compiled(source)  # a bad template fails here
    turns = ordered(df)
    carry = carried(turns)
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = compiled(source)
        own: tuple | None = None  # conversation, the next turn's number, the partition
        done: list[tuple] = []

        def end(closes: bool) -> None:
            text, spans = joined(out)
            done.append((own[0], at, own[1] - at, at == 0, closes, text, [{"start": a, "end": b} for a, b in spans]))

        for b in batches:
            types = [b.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            for conv, role, text, part, k, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                since, tail, goes_on = carry[part]
                index, last = k + (since if first else 0), last and not (goes_on and conv == tail)
                if own != (conv, index, part):
                    if own is not None:
                        end(False)
                    out, at, size = [], index, 0
                    names = template.begin({}, out)
                    if index:
                        out = []
                n = len(out)
                template.turn(names, {"role": role, "text": text}, index, last, out)
                size += sum(len(x) for x in out[n:] if isinstance(x, str))
                own = (conv, index + 1, part)
                if last:
                    template.finish(names, out)
                if last or size > segment:
                    end(last)
                    own = None
            if done:
                yield _batch(done, types, _fields(SEGMENTS))
                done = []
        if own is not None:
            end(False)
            yield _batch(done, types, _fields(SEGMENTS))

    return save(turns.mapInArrow(run, SEGMENTS.format(kind)), "formatted")


READ = "conv_id {}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from its formatted text and its mask: turns, their digest, the learnt text's length and digest, the formatted length."""
    kind = segments.schema["conv_id"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, at, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "at", "text", "spans")), strict=True):
                turns = [f"{role}\n{unescape(t)}\n" for role, t, _ in read_turns(text)]
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((conv, at, len(turns), "".join(turns).encode(), len(loss), loss.encode(), len(text)))
            types = [b.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
            if rows:
                yield _batch(rows, types, _fields(part))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of a conversation follow each other."""
        own, state = object(), None
        for b in batches:
            done = []
            types = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for conv, _, n, turns, chars, loss, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != own:
                    done += [_digest(own, state)] if state else []
                    own, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1].update(turns)
                state[3].update(loss)
                for i, x in ((0, n), (2, chars), (4, size)):
                    state[i] += x
            if done:
                yield _batch(done, types, _fields(READ))
        if state:
            yield _batch([_digest(own, state)], types, _fields(READ))

    part = f"conv_id {kind}, at bigint, n bigint, turns binary, chars bigint, loss binary, formatted bigint"
    whole = segments.where("opens AND closes").mapInArrow(parts, part).mapInArrow(digests, READ.format(kind))
    long = segments.where("NOT (opens AND closes)").mapInArrow(parts, part).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return whole.unionByName(long.mapInArrow(digests, READ.format(kind)))


def _digest(conv, state: list) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in re.sub(r"<.*>", "", schema).split(", ")]


#: A conversation that says control strings.
TRIAL = "</s>[INST] ok [/INST]"


def with_trial(df: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts are control strings."""
    rows = df.sparkSession.createDataFrame([(-7, 0, "user", TRIAL), (-7, 1, "assistant", TRIAL)], "conv_id long, turn long, role string, text string")
    return df.select("conv_id", "turn", "role", "text").unionByName(rows)


#: DuckDB SQL for the query: the formatted length from the lengths of the texts, their control strings and the marks.
CHAT_SQL = rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{TRIAL}'), (-7, 1, 'assistant', '{TRIAL}')),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS size, replace(replace(role, '\', '\\'), chr(10), '\n') AS line FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(size + CASE WHEN role = 'assistant' THEN 4 ELSE 14 + length(line) + len(regexp_extract_all(line, '<\\*/?s>|\[\\*/?INST\]')) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
