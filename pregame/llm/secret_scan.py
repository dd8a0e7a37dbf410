"""Secret scan with a random forest against false positives. DataFrame functions only.

Candidates are runs of at least 16 key characters with a digit, and whatever is assigned to a credential name, from four
characters on and also without a digit. A name ends at its sign: '=' belongs to a run only as padding at its end. Each gets figures of its length, its character
classes and transitions, how much of it dictionary words cover, its path, and the words beside it. A forest trained
on labelled findings votes; the share of votes is the finding's probability. The trained trees are turned into
column expressions, so texts can be scored and redacted in place, without a join.

Labelled findings: any table of candidate, before, after, path, label. ``rule_labels`` makes one from the
candidates themselves: credentials in a known format or assigned to a credential name are findings, all others are not.

Null or empty texts have no candidates. Null contexts and paths count as empty. Without labelled findings nothing is a
secret; with labels of one class every candidate has that class. Repeated rows repeat their findings; positions
are code points, ends exclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pregame.llm.common import materialise, table

#: Labelled findings of one class that the forest is fitted on, at most about.
SAMPLE = 20_000
TREES, DEPTH, SEED = 20, 6, 7
KEY = "A-Za-z0-9+/_-"
_RUN = f"(?<![{KEY}])(?=[A-Za-z+/_-]*+[0-9])[{KEY}]{{16,}}+(?:={{1,2}}(?![={KEY}]))?"
#: A name that ends in a credential word, with what assigns it; bounded, for a look behind.
_NAME = (
    r"(?i:token|secret|passw(?:or)?d|passphrase|pwd|(?:api|access|private|secret|auth|signing|encryption)[_-]?key(?:[_-]?id)?|auth|bearer|credentials?)"
    r"[_-]?[0-9]{0,3}[\"'`]?[ \t]{0,4}(?::=|=>|[=:])"
)
_REST = r"[^\s\"'`,;&<>(){}\[\]|\\$]"
_FIRST = r"(?=[A-Za-z0-9!@#^*~+_./-])(?!//)"
#: Values of such a name, of four characters and more: quoted; right behind the sign; behind blanks with a digit or at the end of the line.
_ASSIGNED = "|".join((
    rf"(?<=[=:>][ \t]{{0,4}}[\"'`])(?<={_NAME}[ \t]{{0,4}}[\"'`])[^\s\"'`<>{{}}$]{{4,}}+(?=[\"'`])",
    rf"(?<=[=:>])(?<={_NAME}){_FIRST}{_REST}{{4,}}+(?![(\[{{])",
    rf"(?<=[=:>][ \t]{{1,4}})(?<={_NAME}[ \t]{{1,4}}){_FIRST}(?:(?={_REST}*?[0-9]){_REST}{{4,}}+(?![(\[{{])|{_REST}{{4,}}+(?=[ \t]*+(?:[\r\n]|\z)))",
))
CANDIDATE = f"{_ASSIGNED}|{_RUN}"
#: A known format at the start, or with its body inside a run, behind no letter or digit.
KNOWN = (
    "^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk_live_|sk-|xox[abprs]-|AIza|eyJ|glpat-|npm_)"
    "|(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{16}|github_pat_[A-Za-z0-9_]{20}|sk_live_[A-Za-z0-9]{16}|sk-[A-Za-z0-9]{20}"
    "|xox[abprs]-[A-Za-z0-9-]{10}|AIza[A-Za-z0-9_-]{30}|eyJ[A-Za-z0-9_-]{17}|glpat-[A-Za-z0-9_-]{16}|npm_[A-Za-z0-9]{30})"
)
CREDENTIAL = r"(?i)(?:token|secret|passw|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|auth|bearer|credential)[^\n]{0,16}$"
#: Assigned values that name no secret: constants, types, the names of settings, dotted lower-case references.
NO_VALUE = (
    r"(?i)^(?:true|false|null|none|nil|undefined|required|optional|string|str|bytes|bool|boolean|integer|number|default|empty|enabled|disabled)[.?!]?$"
    r"|^(?-i:[a-z]+(?:_[a-z]+)*(?:\.[a-z]+(?:_[a-z]+)*)+)$|^(?:[a-z]+_)*(?:token|secret|passw(?:or)?d|passphrase|pwd|key|auth|bearer|credentials?)$"
)
#: Whole words; a letter on either side makes it another word ('latest', 'contest').
_STANDS_IN = "(?<![A-Za-z])(?:example|sample|dummy|placeholder|changeme|your|fake|test)(?![A-Za-z])"
#: In the candidate itself: such a word, or one character eight times in a row, which random keys practically never have.
PLACEHOLDER = rf"(?i){_STANDS_IN}|x{{6}}|(.)\1{{7}}"
#: At the end of the text before: such a word in the very name that is assigned.
PLACEHOLDER_NAME = rf"(?i){_STANDS_IN}[A-Za-z0-9_-]{{0,32}}[\"'`]?[ \t]{{0,4}}[=:][ \t]{{0,4}}[\"'`]?$"
WORDS = "access|account|admin|alpha|api|auth|backup|base|beta|build|cache|change|client|cloud|code|config|data|default|dev|document|download|dummy|example|file|final|first|group|home|host|image|index|internal|item|key|latest|local|login|main|master|model|name|number|object|order|page|pass|password|path|placeholder|prod|project|public|release|report|sample|secret|section|server|service|session|stage|static|string|system|table|test|token|update|upload|user|value|version|your"
BEFORE, AFTER = 80, 40
FEATURES = [
    "length", "digits", "uppers", "hex", "turns", "humps", "syllables", "distinct", "run", "dictionary", "known", "credential",
    "assigned", "quoted", "placeholder", "placeholder_name", "test_path",
]


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Figures of one candidate; every argument is a string column or an element inside an array function."""
    n = F.char_length(candidate).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(candidate, F.lit(pattern)).cast("double")

    def flag(text: Column, pattern: str) -> Column:
        return F.rlike(text, F.lit(pattern)).cast("double")

    return {
        "length": n,
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "hex": flag(candidate, "^[0-9a-fA-F]++$"),
        "turns": count("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]") / n,
        "humps": count("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]") / n,
        "syllables": count("(?i)[bcdfghjklmnpqrstvwxz][aeiou]") / n,
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))).cast("double") / n,
        "run": flag(candidate, r"(.)\1{3}"),
        "dictionary": 1 - F.char_length(F.regexp_replace(F.lower(candidate), F.lit(f"(?:{WORDS})"), F.lit(""))) / n,
        "known": flag(candidate, KNOWN),
        "credential": flag(before, CREDENTIAL),
        "assigned": flag(before, r"[=:]>?\s{0,4}[\"'`]?$"),
        "quoted": (F.rlike(before, F.lit("[\"'`]$")) & F.rlike(after, F.lit("^[\"'`]"))).cast("double"),
        "placeholder": F.greatest(flag(candidate, PLACEHOLDER), flag(candidate, NO_VALUE)),
        "placeholder_name": flag(before, PLACEHOLDER_NAME),
        "test_path": flag(path, "(?i)test|example|sample|fixture|docs?/"),
    }


def _found(text: Column) -> tuple[Column, Column]:
    """Candidates and the pieces of text around them, one more."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)


def _left(last: Column, piece: Column) -> Column:
    """Text before a candidate: the piece between, and the candidate before it, which may be the name that is assigned."""
    return F.right(F.concat(F.coalesce(last, F.lit("")), piece), F.lit(BEFORE))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, start, end, candidate, before, after, path per candidate."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    found, pieces = _found(F.col("text"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(path, F.lit("")).alias("path"))
    rows = rows.filter(F.rlike("text", F.lit(CANDIDATE))).select("doc_id", "path", F.monotonically_increasing_id().alias("row"), found.alias("found"), pieces.alias("pieces"))
    near = F.transform(
        "found", lambda c, i: F.struct(
            c.alias("candidate"), _left(F.get("found", i - 1), F.get("pieces", i)).alias("before"),
            F.left(F.get("pieces", i + 1), F.lit(AFTER)).alias("after"), F.char_length(F.get("pieces", i)).alias("gap"),
        )
    )
    one = rows.select("doc_id", "path", "row", F.posexplode(near).alias("place", "x")).select("doc_id", "path", "row", "place", "x.*")
    along = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("candidate")).over(along)
    return one.withColumn("end", end).select(
        "doc_id", (F.col("end") - F.char_length("candidate")).alias("start"), "end", "candidate", "before", "after", "path"
    )


def with_features(found: DataFrame) -> DataFrame:
    c = [F.coalesce(F.col(x), F.lit("")) for x in ("candidate", "before", "after", "path")]
    return found.withColumns({f"f_{k}": F.coalesce(v, F.lit(0.0)) for k, v in features(*c).items()})


def rule_labels(found: DataFrame) -> DataFrame:
    """Adds ``label`` to candidates: a known format, or assigned to a credential name that is no placeholder's; the
    candidate itself is no placeholder. Words elsewhere beside it do not count."""
    f = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    assigned = (f["credential"] == 1) & (f["assigned"] == 1) & (f["placeholder_name"] == 0) & F.rlike("candidate", F.lit("[A-Za-z]"))
    return found.withColumn("label", (((f["known"] == 1) | assigned) & (f["placeholder"] == 0)).cast("double"))


def train_forest(labelled: DataFrame):
    """Expression builder: features by name to the share of trees that vote for a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = materialise(with_features(labelled.dropna(subset=["candidate", "label"])), "findings")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        only = float(next(iter(counts), 0.0))
        return lambda f: F.lit(only)
    share = F.when(F.col("label") == 1, SAMPLE / counts[1.0]).otherwise(SAMPLE / counts[0.0])
    part = rows.filter(F.pmod(F.xxhash64("candidate", "before", "after"), F.lit(1_000_000)) < share * 1_000_000)
    train = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="x").transform(part)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(train)
    trees = [_tree(t.toDebugString) for t in forest.trees]
    return lambda f: sum((t(f) for t in trees), F.lit(0.0)) / F.lit(float(len(trees)))


def _tree(text: str):
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def read(at: int):
        if m := re.match(r"Predict: ([0-9.]+)", lines[at]):
            return (lambda f, p=float(m[1]): F.lit(p)), at + 1
        m = re.match(r"If \(feature (\d+) <= ([-0-9.eE]+)\)", lines[at])
        low, after = read(at + 1)
        high, after = read(after + 1)
        return (lambda f, k=FEATURES[int(m[1])], x=float(m[2]): F.when(f[k] <= x, low(f)).otherwise(high(f))), after

    return read(0)[0]


def scan_secrets(found: DataFrame, forest, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, probability, secret per candidate."""
    named = with_features(found)
    probability = forest({k: F.col(f"f_{k}") for k in FEATURES})
    return named.withColumn("probability", probability).select("doc_id", "start", "end", "probability", (F.col("probability") >= threshold).alias("secret"))


def redact(docs: DataFrame, forest, threshold: float = 0.5, mark: str = "[SECRET]", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; other columns stay, a column n_chars follows the text."""
    text = F.col(text_col).cast("string")
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    found, pieces = _found(text)

    def part(c: Column, w: Column) -> Column:
        f = features(c, _left(w["last"], w["l"]), F.left(w["r"], F.lit(AFTER)), path)
        return F.concat(w["l"], F.when(forest(f) >= threshold, F.lit(mark)).otherwise(c))

    # the pieces go in as an argument: inside the function they would be cut anew for every candidate
    count = F.size(found)
    sides = F.zip_with(F.slice(pieces, F.lit(1), count), F.slice(pieces, F.lit(2), count), lambda l, r: F.struct(l.alias("l"), r.alias("r")))
    last = F.slice(F.concat(F.array(F.lit("")), found), F.lit(1), count)
    sides = F.zip_with(sides, last, lambda w, x: F.struct(w["l"].alias("l"), w["r"].alias("r"), x.alias("last")))
    whole = F.concat(F.array_join(F.zip_with(found, sides, part), ""), F.element_at(pieces, -1))
    was = "secret_scan_length_before"
    out = docs.withColumn(was, F.char_length(text)).withColumn(text_col, F.when(F.rlike(text, F.lit(CANDIDATE)), whole).otherwise(text))
    if "n_chars" in docs.columns:
        now = F.char_length(text_col).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(now != F.col(was), now).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(candidates(table(spark, sf_dir, "documents")), "candidates")
    return scan_secrets(found, train_forest(rule_labels(found)))
