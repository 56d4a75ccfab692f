"""Quotation linking: conversations in reply order, without the passages their messages quote.

Method: lines are read by their quote level (leading '>' marks, nested as deep as they go); runs of one level are
quoted passages. Passages, their paragraphs and their lines are normalised and hashed, as are the unquoted parts of
all messages, and joined on the hash. A passage belongs to the earliest message that holds it: one before it in its
own conversation, else an earlier one of another conversation. The coarsest match counts.

A message replies to what its outermost linked passage comes from, else to the message before it. Conversations
that quote each other are one thread, named by its smallest conversation; since replies only point back, order by
(thread_id, conv_id, turn) is reply order. Nothing is gathered per conversation: a hot one is rows like any others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.components import components
from tallyward.llm.ordering import with_next
from tallyward.session import written

LEAST_WORDS = 4
PASSAGE, PARAGRAPH, LINE = 0, 1, 2

_MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SAID = re.compile(r"(?:wrote|writes|said|schrieb|écrit|escribió)[^:\n]{0,80}:\s*$", re.IGNORECASE)
_NOT_WORD = re.compile(r"[\W_]+")

Unit = tuple[int, int, int]  # two hashes, number of words


def quote_level(line: str) -> tuple[int, str]:
    """How often a line is quoted, and the line without its marks."""
    mark = _MARK.match(line)
    return (mark.group(1).count(">"), line[mark.end() :]) if mark else (0, line)


def unit(text: str) -> Unit | None:
    """The hash of a text's words in lower case; None without words."""
    words = _NOT_WORD.sub(" ", text.lower()).split()
    if not words:
        return None
    digest = blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()
    return (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), len(words))


def grains(text: str) -> list[tuple[int, Unit]]:
    """(grain, unit) of a passage: itself, its paragraphs and its lines, each distinct unit at its coarsest grain."""
    parts = [(PASSAGE, text)] + [(PARAGRAPH, p) for p in re.split(r"\n\s*\n", text)] + [(LINE, p) for p in text.split("\n")]
    found: dict[Unit, int] = {}
    for grain, part in parts:
        u = unit(part)
        if u:
            found.setdefault(u, grain)
    return [(grain, u) for u, grain in found.items()]


def read_message(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages with their levels, in order.

    The line that announces a quotation ("... wrote:") goes with it.
    """
    lines = [quote_level(line) for line in text.split("\n")]
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    last = 0
    for n, (level, line) in enumerate(lines):
        after = next((lv for lv, rest in lines[n + 1 : n + 3] if rest.strip()), level)
        if after > level and _SAID.search(line):
            last = -1
            continue
        if not level:
            own.append(line)
        elif level == last:
            quoted[-1][1].append(line)
        else:
            quoted.append((level, [line]))
        last = level
    kept = "\n".join(own)
    if quoted:
        kept = re.sub(r"\n{3,}", "\n\n", kept).strip("\n")
    passages = [(level, "\n".join(part).strip("\n")) for level, part in quoted]
    return kept, [(level, part) for level, part in passages if part.strip()]


_UNIT = pa.struct([("grain", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.int32())])
_READ_SQL = (
    "conv_id long, turn long, role string, own string, m1 long, m2 long, n_quotes int, depth int, "
    "units array<struct<grain:int,h1:long,h2:long,words:int>>, "
    "quotes array<struct<level:int,units:array<struct<grain:int,h1:long,h2:long,words:int>>>>"
)


def _units(text: str) -> list[dict]:
    return [{"grain": g, "h1": h1, "h2": h2, "words": n} for g, (h1, h2, n) in grains(text)]


def _read(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, m1, m2, count, depth, units, quotes = [], [], [], [], [], [], []
            for conv, turn, role, text in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                kept, passages = read_message(text or "")
                name = blake2b(repr((conv, turn, role, text)).encode("utf-8", "replace"), digest_size=16).digest()
                own.append(None if text is None else kept)
                m1.append(int.from_bytes(name[:8], "little", signed=True))
                m2.append(int.from_bytes(name[8:], "little", signed=True))
                count.append(len(passages))
                depth.append(max((level for level, _ in passages), default=0))
                units.append(_units(kept))
                quotes.append([{"level": level, "units": _units(part)} for level, part in passages])
            quote_type = pa.list_(pa.struct([("level", pa.int32()), ("units", pa.list_(_UNIT))]))
            arrays = [batch.column(n) for n in range(3)] + [pa.array(own, pa.string()), pa.array(m1, pa.int64()), pa.array(m2, pa.int64())]
            arrays += [pa.array(count, pa.int32()), pa.array(depth, pa.int32()), pa.array(units, pa.list_(_UNIT)), pa.array(quotes, quote_type)]
            names = ["conv_id", "turn", "role", "own", "m1", "m2", "n_quotes", "depth", "units", "quotes"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return messages.mapInArrow(run, _READ_SQL)


def _linked_quotes(read: DataFrame, least_words: int) -> DataFrame:
    """(m1, m2, quote, level, from_conv, from_turn): the message that each linked passage comes from."""
    quote = read.where("n_quotes > 0").select("conv_id", "turn", "m1", "m2", F.posexplode("quotes").alias("quote", "q"))
    asked = quote.select("conv_id", "turn", "m1", "m2", "quote", F.col("q.level").alias("level"), F.explode("q.units").alias("u"))
    asked = asked.select("conv_id", "turn", "m1", "m2", "quote", "level", "u.*")
    wanted = asked.select("h1", "h2").distinct()
    held = read.select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", "u.h1", "u.h2")
    held = held.where("conv_id is not null and turn is not null").join(wanted, ["h1", "h2"], "left_semi")
    per_conv = held.groupBy("h1", "h2", "conv_id").agg(F.min("turn").alias("first_turn"))
    overall = per_conv.groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "first_turn")).alias("first"))
    inside = asked.join(per_conv, ["h1", "h2", "conv_id"]).where("first_turn < turn")
    inside = inside.select("m1", "m2", "quote", "level", F.struct("grain", F.lit(0).alias("far"), F.col("conv_id").alias("c"), F.col("first_turn").alias("t")).alias("hit"))
    outside = asked.where(F.col("words") >= least_words).join(overall, ["h1", "h2"]).where("first.conv_id < conv_id")
    outside = outside.select("m1", "m2", "quote", "level", F.struct("grain", F.lit(1).alias("far"), F.col("first.conv_id").alias("c"), F.col("first.first_turn").alias("t")).alias("hit"))
    best = inside.unionByName(outside).groupBy("m1", "m2", "quote").agg(F.min("level").alias("level"), F.min("hit").alias("hit"))
    return best.select("m1", "m2", "quote", "level", F.col("hit.c").alias("from_conv"), F.col("hit.t").alias("from_turn"))


def reply_order(
    conversations: DataFrame, least_words: int = LEAST_WORDS, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotations, thread_id, reply_conv, reply_turn,
    n_quotes, n_linked, quote_depth.

    A first message replies to nothing. Passages of fewer than ``least_words`` words link inside their own
    conversation only. A null text stays null and quotes nothing; messages without conversation or turn are nobody's
    original and reply to nothing; messages of equal turn both reply to the turn before. Rows repeated in full
    answer alike. An empty table gives no rows.
    """
    columns = ((conv_col, "conv_id", "long"), (turn_col, "turn", "long"), (role_col, "role", "string"), (text_col, "text", "string"))
    messages = conversations.select(*(F.col(c).cast(kind).alias(name) for c, name, kind in columns))
    read = written(_read(messages), "messages")
    links = written(_linked_quotes(read, least_words), "links")
    outer = F.min(F.struct("level", (-F.col("from_turn")).alias("back"), "from_conv", "from_turn"))
    per_message = links.groupBy("m1", "m2").agg(F.count("*").cast("int").alias("n_linked"), outer.alias("source"))
    turns = read.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = with_next(turns, ["conv_id", "turn"], descending=True)
    before = before.where(F.col("next.conv_id") == F.col("conv_id")).select("conv_id", "turn", F.col("next.turn").alias("turn_before"))
    edges = (
        read.select("m1", "m2", "conv_id").join(links.select("m1", "m2", "from_conv"), ["m1", "m2"])
        .where("conv_id <> from_conv").select(F.col("conv_id").alias("a"), F.col("from_conv").alias("b"))
    )
    threads = components(edges).select(F.col("node").alias("conv_id"), F.col("component").alias("thread"))
    told = read.join(per_message, ["m1", "m2"], "left").join(before, ["conv_id", "turn"], "left").join(threads, "conv_id", "left")
    follows = F.when(F.col("turn_before").isNotNull(), F.col("conv_id"))
    return told.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.coalesce("thread", "conv_id").alias("thread_id"),
        F.coalesce("source.from_conv", follows).alias("reply_conv"), F.coalesce("source.from_turn", "turn_before").alias("reply_turn"),
        "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("depth").alias("quote_depth"),
    )
