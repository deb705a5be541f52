r"""Chat formatting with a grammar round trip.

Grammar: a turn is OPEN [\] role LF text CLOSE LF. OPEN and CLOSE are `<s>` and `</s>` for the role assistant,
`[INST]` and `[/INST]` for all others. These four are the control strings. The loss mask covers the text of
assistant turns. A backslash behind OPEN says that the turn is escaped: in its role and text each backslash is
doubled and a backslash stands behind the first character of each control string (and in front of a line feed
in a role).

Rendered text is parsed again by a deterministic parser and the recovered turns are compared with the source;
turns that differ are escaped and the text is rendered anew until both are identical. A turn's end can be told
from its start alone, so a conversation of any length is rendered, parsed and read back in segments of about
SEGMENT characters: memory is bounded though one conversation may hold a third of all rows. Rows meet by one
shuffle on conv_id; a hash over all turns of a conversation is a chain, so they pass one task, as a stream.

Defined cases: null text and null role are empty. Turns with one number are taken in the order of role, then
text; null turns come first. Rows with a null conv_id are one conversation. Very long texts are one segment.
Empty table: no conversations. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEARNED = "assistant"
MARKS = {True: ("<s>", "</s>"), False: ("[INST]", "[/INST]")}
CONTROL = re.compile(r"</?s>|\[/?INST\]")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
SEGMENT = 1 << 20

Turn = tuple[str, str]


def escape(s: str, role: bool = False) -> str:
    s = CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], s.replace("\\", "\\\\"))
    return s.replace("\n", "\\\n") if role else s


def unescape(s: str) -> str:
    return ESCAPED.sub(r"\1", s)


def render_turn(turn: Turn, escaped: bool) -> str:
    role, text = turn
    start, end = MARKS[role == LEARNED]
    return f"{start}\\{escape(role, True)}\n{escape(text)}{end}\n" if escaped else f"{start}{role}\n{text}{end}\n"


def parse(s: str) -> tuple[list[Turn], list[tuple[int, int]], list[int]]:
    """Turns, loss spans in s and the ends of turns; it stops where s leaves the grammar."""
    turns, spans, ends, at = [], [], [], 0
    while at < len(s):
        learned = s.startswith(MARKS[True][0], at)
        start, end = MARKS[learned]
        if not s.startswith(start, at):
            break
        at += len(start)
        escaped = s.startswith("\\", at)
        at += escaped
        nl = s.find("\n", at)
        while escaped and nl > 0 and (nl - len(s[at:nl].rstrip("\\")) - at) % 2:  # an odd run of backslashes escapes it
            nl = s.find("\n", nl + 1)
        stop = CONTROL.search(s, nl + 1) if nl >= 0 else None
        if not stop or stop[0] != end or not s.startswith("\n", stop.end()):
            break
        role, text = s[at:nl], s[nl + 1 : stop.start()]
        if escaped:
            role, text = unescape(role), unescape(text)
        if (role == LEARNED) != learned:
            break
        turns.append((role, text))
        if learned:
            spans.append((nl + 1, stop.start()))
        at = stop.end() + 1
        ends.append(at)
    return turns, spans, ends


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text whose parse equals turns, and its loss spans."""
    escaped = [False] * len(turns)
    while True:
        pieces = [render_turn(t, e) for t, e in zip(turns, escaped, strict=True)]
        text = "".join(pieces)
        got, spans, _ = parse(text)
        if got == turns:
            return text, spans
        before = sum(escaped)
        escaped = [e or parse(p)[0] != [t] for t, p, e in zip(turns, pieces, escaped, strict=True)]
        if sum(escaped) == before:
            raise AssertionError("an escaped turn doesn't parse")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, bool, list]]:
    """(key, first of key, last of key, rows) in pieces of about SEGMENT characters; rows are sorted by the key."""
    key, rows, size, first, any_row = None, [], 0, True, False
    for b in batches:
        for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if any_row and k != key:
                yield key, first, True, rows
                rows, size, first = [], 0, True
            elif size >= SEGMENT:
                yield key, first, False, rows
                rows, size, first = [], 0, False
            key, any_row = k, True
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
    if any_row:
        yield key, first, True, rows


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, formatted, loss_spans: rows of one conversation are together and in order."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    as_key = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        out, segment, size = [], 0, 0
        for key, first, _, turns in _groups(batches):
            segment = 0 if first else segment + 1
            text, spans = render([tuple(t) for t in turns])
            out.append((key, segment, text, [{"start": a, "end": b} for a, b in spans]))
            size += len(text)
            if size >= SEGMENT:
                yield batch(out, to_arrow_type(as_key))
                out, size = [], 0
        if out:
            yield batch(out, to_arrow_type(as_key))

    def batch(out: list, key: pa.DataType) -> pa.RecordBatch:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (key, pa.int32(), pa.string(), spans), strict=True)], ["conv_id", "segment", "formatted", "loss_spans"])

    return rows.mapInArrow(run, f"conv_id {kind}, segment int, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """Read the formatted text back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = []
        for key, first, last, segments in _groups(batches):
            if first:
                n = chars = loss = 0
                turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
            for _, text, spans in segments:
                turns, parsed, ends = parse(text)
                if ends[-1:] != [len(text)] or parsed != [(x["start"], x["end"]) for x in spans]:
                    raise ValueError(f"conversation {key}: the formatted text leaves the grammar")
                n, chars = n + len(turns), chars + len(text)
                for role, t in turns:
                    turns_hash.update(f"{role}\n{t}\n".encode("utf-8", "surrogatepass"))
                escaped_at = iter(turns_under(turns))
                for a, b in parsed:
                    own = next(escaped_at)
                    assert own in (text[a:b], unescape(text[a:b]))
                    loss += len(own)
                    loss_hash.update(own.encode("utf-8", "surrogatepass"))
            if last:
                out.append((key, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return formatted.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turns_under(turns: list[Turn]) -> Iterator[str]:
    """Texts under the loss mask."""
    return (t for role, t in turns if role == LEARNED)


#: The conversation that the query adds.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with conversation -7: a user and an assistant row, both saying PROBE."""
    spark = conversations.sparkSession
    probe = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{PROBE}'), (-7L, 1L, 'assistant', '{PROBE}') AS t(conv_id, turn, role, text)")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))),
e AS (SELECT *, CASE WHEN regexp_matches(text, '</?s>|\[/?INST\]') OR role LIKE '\%' OR contains(role, chr(10))
    THEN 1 + length(role || text) - length(replace(role || text, '\', '')) + length(role) - length(replace(role, chr(10), ''))
      + length(regexp_extract_all(role, '</?s>|\[/?INST\]')) + length(regexp_extract_all(text, '</?s>|\[/?INST\]')) ELSE 0 END AS extra FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' THEN 7 ELSE 13 END + 2 + length(role) + length(text) + extra)::bigint AS formatted_chars
FROM e GROUP BY conv_id
"""
