"""Quotation linking: quote levels, hashed passages, links to original messages, reply order."""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronofold.operators.scans import Running, running
from chronofold.runtime import Work

#: Turns of a conversation that are scanned together.
TURNS = 256


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def mark(text: str) -> int:
    """64-bit hash of a normalised passage."""
    return int.from_bytes(blake2b(normal(text).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def level(line: str) -> tuple[int, str]:
    """Quote level of a line and what it quotes: each '>' at its start, white space between them allowed, is a level."""
    depth, at = 0, 0
    while True:
        rest = line[at:].lstrip()
        if not rest.startswith(">"):
            return depth, (line if depth == 0 else rest)
        depth, at = depth + 1, len(line) - len(rest) + 1


def parse(text: str) -> tuple[str, list[dict], list[int]]:
    """Own text, quoted passages, marks of the own text.

    A passage is a run of lines of one level.  Its units are its whole and, if it
    has several lines, each line, with their lengths as weights.  Own marks are those of the
    whole own text, of its paragraphs and of its lines.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        depth, content = level(line)
        if depth == 0:
            own.append(line)
        elif depth == before:
            passages[-1][1].append(content)
        else:
            passages.append((depth, [content]))
        before = depth
    clean = "\n".join(own).strip("\n") if passages else text
    quotes = []
    for no, (depth, lines) in enumerate(passages):
        whole = normal("\n".join(lines))
        units = [(whole, 2 * len(whole))] if whole else []
        units += [(x, len(x)) for x in map(normal, lines) if x and x != whole]
        quotes.append({"no": no, "depth": depth, "units": [{"h": mark(x), "weight": w} for x, w in units]})
    blocks = {normal(clean), *map(normal, clean.split("\n"))}
    paragraph: list[str] = []
    for line in [*clean.split("\n"), ""]:
        if line.strip():
            paragraph.append(line)
        elif paragraph:
            blocks.add(normal("\n".join(paragraph)))
            paragraph = []
    return clean, quotes, sorted(mark(x) for x in blocks if x)


UNITS = "array<struct<no:int,depth:int,units:array<struct<h:long,weight:long>>>>"


def _parsed(batches):
    units = pa.list_(pa.struct([("h", pa.int64()), ("weight", pa.int64())]))
    kind = pa.list_(pa.struct([("no", pa.int32()), ("depth", pa.int32()), ("units", units)]))
    for batch in batches:
        rows = [(None, [], []) if t is None else parse(t) for t in batch.column("text").to_pylist()]
        clean, quotes, own = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "turn", "role")), pa.array(clean, pa.string()), pa.array(quotes, kind), pa.array(own, pa.list_(pa.int64()))],
            ["conv_id", "turn", "role", "text", "quotes", "own"])


def link_quotations(messages: DataFrame) -> DataFrame:
    """Messages without their quotes, tied to what they reply to, in reply order.

    messages: conv_id, turn (integers), role, text.  Returns conv_id, turn, role, text (own lines only),
    n_quotes (passages), max_depth, n_linked (passages whose original was found), parent_turn,
    root_turn, reply_order, a row for each row.

    A quoted passage's original is the latest earlier message of the
    conversation whose own text, paragraph or line is the same in small letters with white space
    collapsed; if the whole passage is found nowhere, its lines decide by
    their lengths.  A message replies to the original of its outermost quotes, by weight,
    then the later one.  Without such a quote it has no parent and is its own root.  Threads stand in the order of their
    roots, messages of a thread by turn, so that a reply comes after what it replies to;
    reply_order counts from 0 in each conversation.

    Null texts quote nothing and are no original.  Rows with a null conv_id or turn are
    returned with null parent and reply_order, and their turn as root.  Repeated (conv_id, turn) are one message in
    links and count one by one in the order.
    """
    work = Work(messages.sparkSession, "quotes")
    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")}
    parsed = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text")).mapInArrow(
        _parsed, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, text string, quotes {UNITS}, own array<long>")
    parsed = work.cut(parsed, "parsed")
    real = parsed.where("conv_id is not null and turn is not null")

    asked = (real.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.no", "q.depth", F.explode("q.units").alias("u"))
             .select("conv_id", "turn", "no", "depth", F.col("u.h").alias("h"), F.col("u.weight").alias("weight")))
    wanted = asked.select("conv_id", "h").distinct()
    own = (real.select("conv_id", "turn", F.explode("own").alias("h")).distinct().join(wanted, ["conv_id", "h"], "left_semi"))
    rows = (asked.select("conv_id", "h", "turn", F.lit(0).alias("kind"), "no", "depth", "weight")
            .unionAll(own.select("conv_id", "h", "turn", F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("long")))
            .withColumn("chunk", F.floor(F.col("turn") / TURNS)))
    # Quotes come before own text of the same turn, so a message is not its own original.
    found = (running(rows, ["conv_id", "h"], "chunk", ["turn", "kind"], {"source": Running("last", F.when(F.col("kind") == 1, F.col("turn")))})
             .where("kind = 0 and source is not null"))
    votes = found.groupBy("conv_id", "turn", "no", "depth", "source").agg(F.sum("weight").alias("weight"))
    passages = votes.groupBy("conv_id", "turn", "no", "depth").agg(F.max(F.struct("weight", "source")).alias("best"))
    parents = (passages.groupBy("conv_id", "turn", "depth", F.col("best.source").alias("source")).agg(F.sum("best.weight").alias("weight"), F.count("*").alias("n"))
               .groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("depth")).alias("d"), "weight", "source")).alias("best"), F.sum("n").alias("n_linked"))
               .select("conv_id", "turn", F.col("best.source").alias("parent"), "n_linked"))
    parents = work.cut(parents, "parents")

    # Every message's root by doubling: up is an ancestor, twice as far in each round.
    roots = parents.select("conv_id", "turn", F.col("parent").alias("up"))
    while not roots.isEmpty():
        above = roots.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"))
        further = work.cut(roots.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "roots")
        more = not further.where("moved").isEmpty()
        work.drop(roots)
        roots = further.drop("moved") if not more else further.select("conv_id", "turn", "up")
        if not more:
            break

    tied = (real.join(parents, ["conv_id", "turn"], "left").join(roots.select("conv_id", "turn", "up"), ["conv_id", "turn"], "left")
            .withColumn("root", F.coalesce("up", "turn")).withColumn("tie", F.md5(F.concat_ws("|", "role", "text"))))
    tied = work.cut(tied.drop("own", "up"), "tied")
    threads = tied.groupBy("conv_id", "root").agg(F.count("*").alias("n")).withColumn("chunk", F.floor(F.col("root") / TURNS))
    threads = running(threads, ["conv_id"], "chunk", ["root"], {"before": Running("sum", F.col("n"), False)}).select("conv_id", "root", "before")
    placed = running(tied.withColumn("chunk", F.floor(F.col("turn") / TURNS)), ["conv_id", "root"], "chunk", ["turn", "tie"], {"inside": Running("sum", F.lit(1), False)})
    placed = placed.join(threads, ["conv_id", "root"]).withColumn("reply_order", (F.col("before") + F.col("inside")).cast("long"))
    rest = parsed.where("conv_id is null or turn is null").select(
        "*", F.lit(None).cast("long").alias("n_linked"), F.lit(None).cast(kinds["turn"]).alias("parent"), F.col("turn").alias("root"), F.lit(None).cast("long").alias("reply_order"))
    columns = ["conv_id", "turn", "role", "text", F.size("quotes").cast("long").alias("n_quotes"),
               F.coalesce(F.array_max(F.transform("quotes", lambda q: q.depth)), F.lit(0)).cast("int").alias("max_depth"),
               F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), "reply_order"]
    return placed.select(*columns).unionAll(rest.select(*columns))
