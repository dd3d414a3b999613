"""Personal data: fixed patterns, and identifiers found through their context.

The base finds e-mail and IP addresses, card and phone numbers by pattern and check. Base entities are the
seeds of a bootstrap: signs (tokens with a digit or @, numbers in several groups as one) and their lexical patterns (the
word before or after with the sign's shape; for addresses and numbers of 7 digits the word alone) make a graph. In each round a pattern's confidence is the share of its distinct
values that are known, over one more than their number; values that confident patterns vouch for become
known, and raise other patterns in the next round. Signs beside a confident pattern that overlap no base span and look like the
kind most of the pattern's seeds have (``OUTLINES``) are added as spans of that kind, whole; parts of numbers never are.

Everything is DataFrame functions. Patterns are possessive and start only where a match may start, so a search
is linear in the text and no repetition recurses.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents, materialise, query, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
# the same matches as the plain patterns, without backtracking
FORMS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# numbers with the separators of cards and phones between them, not touching letters; otherwise one token with a digit or @
SIGN = (r"(?<!\S)(?:[+(]{0,2}+[0-9]++(?:[\x20().-]{1,3}+[0-9]++(?=[^\p{L}\p{N}\s]*+(?:\s|\z)|[\x20().-]{1,3}+[0-9]))*+(?=[^\p{L}\p{N}\s]*+(?:\s|\z))"
        r"|[^\s0-9@]*+[0-9@]\S*+)")
LONG = 7                # digits from which a number is taken for an identifier by its context alone
# what a value must look like to be added as a kind
OUTLINES = {
    "email": r"^[^@\s]++@[^@\s.]++(?:\.[^@\s.]++)++$",
    "ip": r"^[0-9]++(?:\.[0-9]++){3}+$",
    "card": r"^(?:[0-9][\x20-]?+){12,19}+$",
    "phone": r"^[+(]{0,2}+(?:[0-9][\x20().-]{0,3}+){7,15}+$",
}
CELL = 64               # characters of a cell in which tokens and base spans meet
BLOCK = 256             # entries of an array that are folded together
CHUNK = 4096            # characters of the chunks a text is cut out of
ROUNDS = 3
CONFIDENT = 0.8         # share of known values a pattern needs
SUPPORT = 3             # distinct known values a pattern needs
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _bound(names: dict, body) -> Column:
    """``body`` of a struct of the named columns, each evaluated once."""
    given = F.array(F.struct(*[c.alias(n) for n, c in names.items()]))
    return F.get(F.transform(given, body), F.lit(0))


def before_each(values: Column, fold) -> Column:
    """For each entry of an array of integers the fold, from 0, of all entries before it; one more for all of them.

    Entries are folded in blocks, so an entry costs a block, not the array.
    """
    zero, n = F.lit(0), F.size(values)
    blocks = _bound({"v": values}, lambda a: F.transform(
        F.sequence(zero, F.floor(F.size(a["v"]) / BLOCK).cast("int")), lambda b: F.slice(a["v"], b * BLOCK + 1, F.lit(BLOCK))))
    totals = _bound({"blocks": blocks, "n": n}, lambda a: F.struct(
        a["blocks"].alias("blocks"), a["n"].alias("n"), F.transform(a["blocks"], lambda x: F.aggregate(x, zero, fold)).alias("totals")))
    heads = F.transform(F.array(totals), lambda a: F.struct(a["blocks"].alias("blocks"), a["n"].alias("n"), F.transform(
        a["totals"], lambda _, b: F.aggregate(F.slice(a["totals"], F.lit(1), b), zero, fold)).alias("heads")))

    def at(a, i):
        block = F.floor(i / BLOCK).cast("int")
        return F.aggregate(F.slice(F.get(a["blocks"], block), F.lit(1), i % BLOCK), F.get(a["heads"], block), fold)

    return F.get(F.transform(heads, lambda a: F.transform(F.sequence(zero, a["n"]), lambda i: at(a, i))), zero)


def matches(text: Column, form: str) -> Column:
    """Array of (start, value) of the leftmost non-overlapping matches, in code points."""
    def placed(a):
        # a gap before each match, and one at the end
        lengths = F.transform(a["gap"], lambda g, i: F.length(g) + F.coalesce(F.length(F.get(a["value"], i - 1)), F.lit(0)))
        # the end of gap i is the start of match i
        return F.struct(a["value"].alias("value"), before_each(lengths, lambda x, y: x + y).alias("at"))

    found = _bound({"gap": F.split(text, form, -1), "value": F.regexp_extract_all(text, F.lit(form), F.lit(0))}, placed)
    return F.get(F.transform(F.array(found), lambda a: F.transform(a["value"], lambda v, i: F.struct(
        F.get(a["at"], i + 1).alias("start"), v.alias("value")))), F.lit(0))


def in_context(text: Column, form: str) -> Column:
    """Array of (start, value, left, right, last, next): matches, the text on both sides up to the next match, and that match."""
    return _bound({"at": matches(text, form), "gap": F.split(text, form, -1)}, lambda a: F.transform(a["at"], lambda x, i: F.struct(
        x["start"].alias("start"), x["value"].alias("value"), F.get(a["gap"], i).alias("left"), F.get(a["gap"], i + 1).alias("right"),
        F.get(a["at"], i - 1)["value"].alias("last"), F.get(a["at"], i + 1)["value"].alias("next"))))


def luhn(digits: Column) -> Column:
    """Whether the check sum over a string of digits is a multiple of ten."""
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(
        i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2 / 10).cast("int") + x.cast("int") * 2 % 10)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: F.coalesce(
            F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, p.cast("decimal(38,0)") <= 255), F.lit(False)))
    if kind == "card":
        return luhn(digits)     # the form holds 12 to 19 digits
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans(found: Column, rank: int, kind: str) -> Column:
    """Spans of the matches that are valid."""
    return F.transform(F.filter(found, lambda m: valid(kind, m["value"])), lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["value"])).alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds in order of start and kind; texts without digits and @ are not searched."""
    none = F.array().cast(SPANS)
    parts = []
    for rank, kind in enumerate(KINDS):
        rows = _spans(matches(text, FORMS[kind]), rank, kind)
        may = F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) if kind == "phone" else F.regexp_like(text, F.lit("[0-9]"))
        parts.append(F.when(may, rows).otherwise(none))
    return F.when(F.regexp_like(text, F.lit("[0-9@]")), F.array_sort(F.concat(*parts))).otherwise(none).cast(SPANS)


def signs(rows: DataFrame) -> DataFrame:
    """d, h, start, end, value, shape, kind (of the base span it overlaps, or null), before, after; equal rows count once."""
    found = rows.where(F.regexp_like("text", F.lit("[0-9@]"))).select(
        "d", "h", F.explode(in_context(F.col("text"), SIGN)).alias("m")).select("d", "h", "m.*")
    # signs of punctuation around the token are not part of it
    edge = r"^((?:[^\p{L}\p{N}+(]|[+(](?![+(]?[0-9]))*+)"
    core = F.regexp_replace(F.regexp_replace("value", edge, ""), r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    found = found.withColumns({"start": F.col("start") + F.length(F.regexp_extract("value", edge, 1)), "value": core})
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"\p{N}++", "9"), r"\p{L}++", "a"), r"(?:a9|9a)(?:[a9])*+", "x")
    # the neighbouring word, or the neighbouring sign where only blanks lie between
    before = F.when(F.regexp_like("left", F.lit(r"\S")), F.regexp_extract("left", r"(?<!\S)(\S++)\s*+$", 1)).otherwise(F.col("last"))
    after = F.when(F.regexp_like("right", F.lit(r"\s\S")), F.regexp_extract("right", r"\s(\S++)", 1)).otherwise(F.col("next"))
    found = found.select("d", "h", "start", (F.col("start") + F.length("value")).alias("end"), "value", shape.alias("shape"),
                         ascii_lower(F.coalesce(before, F.lit(""))).alias("before"), ascii_lower(F.coalesce(after, F.lit(""))).alias("after"))
    found = materialise(found.where("end > start").dropDuplicates(["d", "h", "start"]))

    def cells(df):
        return df.withColumn("cell", F.explode(F.sequence(F.expr(f"start div {CELL}"), F.expr(f"(end - 1) div {CELL}"))))

    base = cells(rows.select("d", "h", F.explode("spans").alias("s")).select("d", "h", "s.*").distinct()).withColumnsRenamed(
        {"start": "from", "end": "to"})
    hit = cells(found.select("d", "h", "start", "end")).join(base, ["d", "h", "cell"]).where("from < end and to > start").groupBy(
        "d", "h", "start").agg(F.min(F.struct("from", "rank", "kind"))["kind"].alias("kind"))
    return found.join(hit, ["d", "h", "start"], "left")


def patterns_of(before: Column, after: Column, shape: Column, value: Column) -> Column:
    """Patterns of a sign: a neighbouring word with the token's shape, and for addresses and long numbers the word alone."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    number = F.regexp_like(value, F.lit(r"^[+(0-9][0-9\x20().-]*+$")) & (digits >= LONG)
    sort = F.when(F.contains(value, F.lit("@")), "@").when(number, "#")
    made = [F.when(word != "", F.concat_ws(" ", F.lit(side), word, F.concat(F.lit("="), shape))) for side, word in (("<", before), (">", after))]
    made += [F.when((word != "") & sort.isNotNull(), F.concat_ws(" ", F.lit(side), word, sort)) for side, word in (("<", before), (">", after))]
    return F.array_compact(F.array(*made))


def bootstrap(found: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """d, h, start, end, kind of the tokens in ``found`` (stored) that confident patterns add."""
    at = found.select("d", "h", "start", "end", "value", "kind", F.explode(
        patterns_of(F.col("before"), F.col("after"), F.col("shape"), F.col("value"))).alias("pattern"))
    # one edge for each pattern and value, however often they meet
    edges = materialise(at.groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    values = edges.groupBy("value").agg(F.max("kind").alias("kind"), F.lit(0.0).alias("score"))
    values = materialise(values.withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)))
    good = None
    for _ in range(rounds):
        scored = edges.select("pattern", "value").join(values, "value")
        known = F.when(F.col("score") >= confident, F.col("score")).otherwise(0.0)
        patterns = scored.groupBy("pattern").agg(
            (F.sum(known) / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count_if(F.col("score") >= confident).alias("known"),
            *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
        kind = F.greatest(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)])["kind"]
        good = materialise(patterns.where((F.col("confidence") >= confident) & (F.col("known") >= support)).select(
            "pattern", "confidence", kind.alias("kind")))
        reached = edges.select("pattern", "value").join(good, "pattern").groupBy("value").agg(
            F.max(F.struct("confidence", "kind")).alias("best"))
        values = materialise(values.join(reached, "value", "left").select(
            "value", F.coalesce("kind", "best.kind").alias("kind"), F.greatest("score", F.coalesce("best.confidence", F.lit(0.0))).alias("score")))
    looks = reduce(lambda c, k: c | ((F.col("kind") == k) & F.regexp_like("value", F.lit(OUTLINES[k]))), KINDS, F.lit(False))
    new = at.where("kind is null").drop("kind").join(good, "pattern").where(looks)
    return new.groupBy("d", "h", "start", "end").agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"))


def find(docs: DataFrame, carry=(), rounds: int = ROUNDS) -> DataFrame:
    """doc_id, the ``carry`` columns, text, base (spans), spans (base and added) of every row.

    Spans are (start, rank, kind, end) in code points, end exclusive, ordered by start and kind. A null text is
    empty; one without digits and @ has no spans. Equal rows have equal spans, and count once where a
    pattern's distinct values count. Columns not carried are left out, so their names may clash.
    """
    rows = documents(docs, *carry).withColumns({"d": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")), "h": F.xxhash64("text")})
    rows = rows.withColumn("base", base_spans(F.col("text")))
    searched = materialise(rows.where(F.regexp_like("text", F.lit("[0-9@]"))).select("d", "h", "text", F.col("base").alias("spans")))
    added = bootstrap(materialise(signs(searched)), rounds)
    rank = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), -1))
    added = added.groupBy("d", "h").agg(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end")).cast(SPANS).alias("added"))
    known = materialise(searched.select("d", "h", F.col("spans").alias("base")).dropDuplicates(["d", "h"]).join(added, ["d", "h"], "left"))
    none = F.array().cast(SPANS)
    base, more = F.coalesce(known["base"], none), F.coalesce("added", none)
    return rows.drop("base").join(known, ["d", "h"], "left").select(
        "doc_id", *carry, "text", base.alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """Text with each span replaced by its kind in brackets; of overlapping spans the first names the stretch."""
    def cut(chunks, a, b):
        """Code points a to b, read from the chunks that hold them."""
        first = F.floor(a / CHUNK).cast("int")
        held = F.array_join(F.slice(chunks, first + 1, F.greatest(F.floor((b - 1) / CHUNK).cast("int") - first + 1, F.lit(0))), "")
        return F.when(b > a, F.substring(held, a - first * CHUNK + 1, b - a)).otherwise("")

    def masked(g):
        parts = F.transform(g["spans"], lambda s, i: F.when(s["end"] > F.get(g["at"], i), F.when(s["start"] < F.get(g["at"], i), F.lit("")).otherwise(
            F.concat(cut(g["chunks"], F.get(g["at"], i), s["start"]), F.lit("["), s["kind"], F.lit("]")))))
        return F.concat(F.array_join(parts, ""), cut(g["chunks"], F.get(g["at"], F.size(g["spans"])), g["length"]))

    ends = before_each(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))      # where the masked part ends so far
    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))
    whole = _bound({"chunks": chunks, "spans": spans, "at": ends, "length": F.length(text)}, masked)
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op8_bootstrap_pii")
def op8(spark, base):
    found = find(table(spark, base, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
