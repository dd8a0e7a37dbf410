"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped contexts. DataFrame functions only.

1. One pass over the texts finds the fixed kinds (email, ip, card, phone) and every token with a digit or an at sign,
   each with the words to its left and right. Only these are kept; texts are not shuffled.
2. The spans of the fixed kinds are the seeds, in place of the tokens they cover. Contexts (the word before, the two words
   before, the words around) are patterns. Patterns and values form a graph: a pattern's score is the share of its distinct
   values that are believed; seeds and all values of trusted patterns are believed. Rounds alternate the two until no
   value joins. (A value that had the score of its best trusted pattern would reach 1 over the rounds, as that pattern's
   score rises with it; so belief is yes or no.)
3. Tokens of an identifier's shape beside a trusted pattern, outside all fixed spans, are reported as kind ``id``.

Patterns are written without groups that repeat, so that long runs need no stack, and start only at the left end
of a run, so that they take linear time; they match what the contract's patterns match.
Null or empty text has no spans. Rows repeating an id are rows of their own. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.llm.common import materialise, table

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[{_LABEL}]++\.[{_LABEL}])[{_LABEL}.]*?[{_LABEL}](?![{_LABEL}]|\.[{_LABEL}])",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[ -]?[0-9])[0-9 -]*?[0-9](?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Necessary for a valid match; spares most texts the rest.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9][ ().0-9-]"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: A pattern is trusted with this share of believed values and so many distinct ones.
TRUST, SUPPORT = 0.8, 3
IDENTIFIER = r"^(?=(?:[^0-9]*+[0-9]){4})[A-Za-z0-9#/_.:-]{6,64}$"
SPAN = "array<struct<start:bigint,end:bigint,value:string,l:string,r:string>>"
NEAR = "array<struct<start:bigint,end:bigint,value:string,one:string,two:string,after:string>>"
BEFORE, AFTER = 80, 40
#: Matches that are placed by one running sum.
PLACED = 200
#: Spans meet the tokens that share a stretch of so many code points.
STRETCH = 64


def _cuts(text: Column, pattern: str) -> Column:
    """Matches with their places and the text beside them, left to right."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    count = F.size(found)
    zero = lambda at: F.struct(at.cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["f"])
        left = F.right(F.concat(x["q"], x["p"]), F.lit(BEFORE))
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["f"].alias("value"), left.alias("l"), x["r"].alias("r"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    # f: match, p: piece before it, q: end of the match before, r: text after it
    previous = F.transform(F.slice(F.concat(F.array(F.lit("")), found), F.lit(1), count), lambda f: F.right(f, F.lit(BEFORE)))
    right = F.zip_with(F.slice(pieces, F.lit(2), count), F.slice(F.concat(found, F.array(F.lit(""))), F.lit(2), count), lambda p, f: F.left(F.concat(F.left(p, F.lit(AFTER)), F.left(f, F.lit(AFTER))), F.lit(AFTER)))
    ends = F.zip_with(previous, right, lambda q, r: F.struct(q.alias("q"), r.alias("r")))
    pairs = F.zip_with(found, F.slice(pieces, F.lit(1), count), lambda f, p: F.struct(f.alias("f"), p.alias("p")))
    pairs = F.zip_with(pairs, ends, lambda x, e: F.struct(x["f"].alias("f"), x["p"].alias("p"), e["q"].alias("q"), e["r"].alias("r")))

    def placed(pairs: Column) -> Column:
        # arrays grow by copying, so matches are placed in blocks, each from the length of the blocks before it
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(pairs) / F.lit(PLACED)).cast("int") - 1)), lambda b: F.slice(pairs, b * PLACED + 1, F.lit(PLACED)))
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + F.char_length(x["p"]) + F.char_length(x["f"])))
        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
        before = F.aggregate(lengths, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.aggregate(b, zero(at), step, lambda acc: acc["spans"])))

    # bound once as the only element of an array, so that it is not evaluated again for each block
    return F.get(F.transform(F.array(pairs), placed), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = F.split(value, r"\.")
        return F.forall(small, lambda p: F.rlike(p, F.lit("^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        n = F.char_length(_digits(value))
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def _near(s: Column, value: Column) -> Column:
    """A match with its neighbouring words. Characters joined to it belong to its token; a word with a digit or an at sign
    is a token of its own and ends the context."""
    plain = lambda w: F.when(F.rlike(w, F.lit("[0-9@]")), F.lit("")).otherwise(F.regexp_replace(F.lower(w), r"[^\p{L}]", ""))
    left = F.filter(F.split(F.regexp_replace(s["l"], r"\S++\z", ""), r"\s+"), lambda x: x != "")
    right = F.filter(F.split(F.regexp_replace(s["r"], r"\A\S++", ""), r"\s+"), lambda x: x != "")
    one = plain(F.coalesce(F.get(left, F.size(left) - 1), F.lit("")))
    two = plain(F.coalesce(F.get(left, F.size(left) - 2), F.lit("")))
    after = plain(F.coalesce(F.get(right, F.lit(0)), F.lit("")))
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), value.alias("value"), one.alias("one"), two.alias("two"), after.alias("after"))


def fixed_spans(text: Column, kind: str) -> Column:
    spans = F.transform(F.filter(_cuts(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"])), lambda s: _near(s, s["value"]))
    return F.when(F.rlike(text, F.lit(NEEDED[kind])), spans).otherwise(F.array().cast(NEAR))


def _context(text: Column) -> Column:
    """Tokens with their places and neighbouring words."""
    tokens = F.transform(_cuts(text, TOKEN), lambda s: _near(s, F.regexp_replace(s["value"], r"^[^\w+@]+|[^\w@]+$", "")))
    return F.when(F.rlike(text, F.lit("[0-9@]")), tokens).otherwise(F.array().cast(NEAR))


def trusted_patterns(instances: DataFrame) -> DataFrame:
    """Patterns worth trusting: ``instances`` holds pattern, value, seed (boolean); repeated rows count once.

    Trusts patterns and believes values in turn until no value joins; every round is a grouped aggregation and a join
    on the graph's edges.
    """
    edges = materialise(instances.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    believed = materialise(edges.groupBy("value").agg(F.max("seed").alias("seed")).filter("seed").select("value"), "values")
    count = believed.count()
    while True:
        held = edges.join(believed, "value").groupBy("pattern").agg(F.count("*").alias("hits"))
        patterns = materialise(
            held.join(sizes, "pattern").select("pattern", (F.col("hits") / F.col("n")).alias("confidence"), "hits").filter((F.col("confidence") >= TRUST) & (F.col("hits") >= SUPPORT)),
            "patterns",
        )
        believed = materialise(believed.unionByName(edges.join(patterns, "pattern").select("value")).distinct(), "values")
        now = believed.count()
        if now == count:
            return patterns
        count = now


def _text_of(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id per row."""
    kinds = list(PATTERNS)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    seen = materialise(
        rows.select("doc_id", F.monotonically_increasing_id().alias("row"), *(fixed_spans(F.col("text"), k).alias(k) for k in kinds), _context(F.col("text")).alias("tokens")),
        "pii",
    )
    base = F.concat(*(F.col(k) for k in kinds))
    tokens = seen.filter("size(tokens) > 0").select("row", F.explode("tokens").alias("t")).select("row", "t.*").filter("value <> ''")
    whole = lambda *c: F.concat_ws(" ", *c)
    wordy = [
        F.when(F.col("one") != "", whole(F.lit("1"), F.col("one"))),
        F.when((F.col("one") != "") & (F.col("two") != ""), whole(F.lit("2"), F.col("two"), F.col("one"))),
        F.when((F.col("one") != "") & (F.col("after") != ""), whole(F.lit("3"), F.col("one"), F.lit("_"), F.col("after"))),
    ]
    stretches = F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))).alias("stretch")
    spans = seen.select("row", F.explode(base).alias("t")).select("row", F.col("t.start").alias("start"), F.col("t.end").alias("end"))
    spans = spans.select("row", F.col("start").alias("a"), F.col("end").alias("b"), stretches)
    covered = tokens.select("row", "start", "end", stretches).join(spans, ["row", "stretch"]).filter("a < end AND b > start").select("row", "start").distinct()
    placed = tokens.join(covered, ["row", "start"], "left_anti").select("row", "start", "end", "value", F.array_compact(F.array(*wordy)).alias("patterns"))
    seeds = seen.select(F.explode(base).alias("t")).select("t.*").select("value", F.array_compact(F.array(*wordy)).alias("patterns"))
    edges = placed.select("value", F.lit(False).alias("seed"), F.explode("patterns").alias("pattern")).unionByName(
        seeds.select("value", F.lit(True).alias("seed"), F.explode("patterns").alias("pattern"))
    )
    trusted = trusted_patterns(edges)
    open_ = placed.filter(F.rlike("value", F.lit(IDENTIFIER))).select("row", "start", "end", F.explode("patterns").alias("pattern"))
    found = open_.join(trusted, "pattern").select("row", "start", "end").distinct()
    more = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ids"))
    own = F.concat(*(_text_of(k, F.col(k)) for k in kinds))
    return seen.join(more, "row", "left").select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(F.array_join(own, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(own, F.coalesce(_text_of("id", F.col("ids")), F.array().cast("array<string>"))), ",").alias("spans"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_id"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
