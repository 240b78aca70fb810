"""Secret scan: candidates by pattern, false positives removed by a random forest.

The forest looks at a candidate's length, its character transitions, how much of it
the corpus's own dictionary covers, whether it looks like a path, and its neighbouring
words.  It is trained from labelled findings: all of those in documents that strict
rules can label, and generated ones for shapes that the documents lack.  Built-in
functions and Spark's own tree learner only; no Python runs on executors.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votegrid.llm.common import held_out
from votegrid.storage import Scratch

# Shapes that can hold a secret, in Java's regular expressions.  No shape
# ends before its run of characters does, and possessive quantifiers keep them linear.
ASSIGNED = r"(?i:passwords?|passwd|pwd|secret|token|api_?key|auth)[\"']?\s*+[:=]\s*+[\"']?[^\s\"']{6,}+"
UPPER = r"(?<![A-Za-z0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])"
# with a digit, or a change of case, or longer than most words
MIXED = (
    r"(?<![A-Za-z0-9+/_\-])(?:(?=[A-Za-z+/_\-]*+[0-9])|(?=[A-Za-z0-9+/_\-]*?[a-z][A-Z])|(?=[A-Za-z0-9+/_\-]{24}))"
    r"[A-Za-z0-9+/_\-]{16,}+={0,2}"
)
PEM = r"-----BEGIN (?:[A-Z0-9]++ ){0,3}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-[^-]++){0,20}+-----END [A-Z0-9 ]{0,40}-----"
CANDIDATE = f"{PEM}|{ASSIGNED}|{UPPER}|{MIXED}"
# What known issuers' secrets look like from end to end.
ISSUED = (
    r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,}|xox[abps]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}|"
    r"eyJ[A-Za-z0-9_\-]{20,}|-----BEGIN [^-]*PRIVATE KEY[^-]*-----.*)"
)
# Frequent word pieces of English, French, German and Spanish, the
# dictionary where there is no corpus to learn one from.
PIECES = (
    "the and ing ion ent her for tha nth int ere tio ter est ers ati hat ate all eth hes ver his oft ith fth sth oth res ont "
    "les ait que ous men des eur ons ant our tre ein ich der und die sch cht ung gen den ung ver ado con par nte ado cion mente"
).split()
# Words near a finding that speak for or against it.
TELLING = "password|passwd|pwd|secret|token|key|auth|credential|login|bearer|private|aws"
HARMLESS = "uuid|sha|sha256|md5|commit|hash|checksum|digest|example|sample|test|order|invoice|isbn|version|revision|id|card|phone"

FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_symbols", "f_transitions", "f_repeats", "f_distinct", "f_hex", "f_covered",
    "f_path", "f_extension", "f_uuid", "f_prefix", "f_assigned", "f_telling", "f_harmless",
]
#: Pieces that the dictionary has.
DICTIONARY = 150
#: Labelled findings generated for training, trees and depth of the forest.
FINDINGS, TREES, DEPTH, SEED = 6_000, 24, 8, 42
#: Least number of thresholds of a feature that a tree looks at.
BINS = 32


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent pieces of three and four letters of the documents' words."""
    words = (
        docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.length("word") >= 3)
    )
    cuts = F.expr("flatten(transform(array(3, 4), n -> transform(sequence(1, greatest(length(word) - n + 1, 1)), k -> substring(word, k, n))))")
    pieces = words.select(F.explode(cuts).alias("piece"), "n").where(F.length("piece") >= 3).groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in pieces.orderBy(F.desc("n"), "piece").limit(size).collect()] or PIECES


def with_features(found: DataFrame, pieces: list[str] = PIECES) -> DataFrame:
    """Adds the forest's inputs to rows of ``candidate``, ``before`` and ``after``."""
    value = F.regexp_replace("candidate", r"^(?i:[a-z_]+)[\"']?\s*[:=]\s*[\"']?(?=.)", "")
    near = F.lower(F.concat_ws(" ", "before", F.regexp_extract("candidate", r"^((?i:[a-z_]+))[\"']?\s*[:=]", 1), "after"))
    size = F.greatest(F.length("value"), F.lit(1)).cast("double")
    letters = F.lower(F.col("value"))
    # longer pieces first, so that they are not hidden by their beginnings
    covered = size - F.length(F.regexp_replace(letters, "|".join(sorted(pieces, key=lambda x: (-len(x), x))), ""))
    kinds = r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])|[A-Z]{2}(?=[a-z])"
    made = {
        "f_length": size, "f_digits": _count(F.col("value"), "[0-9]") / size, "f_upper": _count(F.col("value"), "[A-Z]") / size,
        "f_lower": _count(F.col("value"), "[a-z]") / size, "f_symbols": _count(F.col("value"), "[^A-Za-z0-9]") / size,
        "f_transitions": _count(F.col("value"), kinds) / size, "f_repeats": _count(F.col("value"), r"(.)(?=\1)") / size,
        "f_distinct": F.array_size(F.array_distinct(F.split("value", ""))).cast("double"),
        "f_hex": F.col("value").rlike("^[0-9a-f]+$").cast("double"), "f_covered": covered / size,
        "f_path": _count(F.col("value"), r"[/\\]"), "f_extension": F.col("value").rlike(r"\.[a-z]{2,4}$").cast("double"),
        "f_uuid": F.col("value").rlike("(?i)[0-9a-f]{8}-[0-9a-f]{4}-").cast("double"),
        "f_prefix": F.col("value").rlike("^(AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-|AIza|eyJ)").cast("double"),
        "f_assigned": F.col("candidate").rlike(r"^(?i:[a-z_]+)[\"']?\s*[:=]").cast("double"),
        "f_telling": F.col("near").rlike(rf"\b(?:\w*_)?(?:{TELLING})\b").cast("double"),
        "f_harmless": F.col("near").rlike(rf"\b(?:{HARMLESS})\b").cast("double"),
    }
    return found.withColumns({"value": value, "near": near}).withColumns(made)


def judged_findings(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings in documents that strict rules can label (:func:`judged`)."""
    return judged(candidates(docs, id_col, text_col), pieces)


def judged(found: DataFrame, pieces: list[str]) -> DataFrame:
    """Those candidates that strict rules can label: 1 for an issuer's shape, or a
    varied value assigned to a telling name; 0 for numbers, identifiers, words and
    paths made of words, and what harmless words stand beside.  Others, and those
    for which both speak, are left out."""
    found = with_features(found, pieces)
    strong = (F.col("f_assigned") == 1) & (F.col("f_length") >= 12) & (F.col("f_distinct") >= 8) & (F.col("f_covered") < 0.5)
    secret = F.col("value").rlike(f"(?s){ISSUED}") | strong
    plain = (
        (F.col("f_digits") == 1) | (F.col("f_uuid") == 1) | (F.col("f_covered") >= 0.6) | ((F.col("f_path") >= 2) & (F.col("f_covered") >= 0.4))
        | ((F.col("f_harmless") == 1) & (F.col("f_telling") == 0) & (F.col("f_assigned") == 0))
    )
    label = F.when(secret & ~plain, 1.0).when(plain & ~secret, 0.0)
    return found.select("candidate", "before", "after", label.alias("label")).where("label is not null")


def labelled_findings(spark: SparkSession, rows: int = FINDINGS, first: int = 0) -> DataFrame:
    """Generated findings, numbered from ``first``, with ``label`` 1 (secret) or 0
    (harmless look-alike)."""
    noise = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 256)
    strong = lambda k, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(noise(k), noise(k + 50)))), "[+/=]", "q"), 1, n)
    upper = lambda k, n: F.substring(F.upper(F.translate(strong(k, 80), "018", "QZX")), 1, n)
    hexed = lambda k, n: F.substring(F.concat(noise(k), noise(k + 50)), 1, n)
    digits = lambda k, n: F.substring(F.regexp_replace(F.concat(noise(k), noise(k + 50), noise(k + 90)), "[a-f]", ""), 1, n)
    piece = lambda k: F.element_at(F.array(*map(F.lit, PIECES)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PIECES))) + 1).cast("int"))
    word = lambda k, n: F.concat(*[piece(k * 10 + j) for j in range(n)])
    odd = lambda k, n: F.substring(F.translate(noise(k), "0123456789abcdef", "abdegiklmnoprstu"), 1, n)
    uuid = F.concat_ws("-", hexed(1, 8), hexed(2, 4), hexed(3, 4), hexed(4, 4), hexed(5, 12))
    shapes = [  # candidate, word before, label
        (F.concat(F.lit("AKIA"), upper(1, 16)), word(7, 2), 1),
        (F.concat(F.lit("password="), hexed(1, 16)), word(7, 2), 1),
        (F.concat(F.lit('api_key = "'), hexed(1, 40)), word(7, 2), 1),
        (F.concat(F.lit("ghp_"), strong(1, 36)), word(7, 2), 1),
        (strong(1, 40), F.lit("secret key"), 1),
        (F.concat(F.lit("token: "), strong(1, 24)), word(7, 2), 1),
        (hexed(1, 40), F.lit("private token"), 1),
        (F.concat(F.lit("sk-"), strong(1, 44)), word(7, 2), 1),
        (hexed(1, 64), F.lit("sha256 checksum"), 0),
        (hexed(1, 40), F.lit("commit"), 0),
        (uuid, F.lit("order id"), 0),
        (uuid, word(7, 2), 0),
        (digits(1, 16), word(7, 2), 0),
        (F.concat_ws("/", F.lit(""), word(1, 2), word(2, 3), F.concat(word(3, 2), digits(4, 2))), word(7, 2), 0),
        (F.concat_ws("/", F.lit(""), odd(1, 3), odd(2, 4), F.concat(odd(3, 6), digits(4, 1)), odd(5, 9)), word(7, 2), 0),
        (F.concat_ws("/", odd(1, 5), F.concat(odd(2, 4), digits(4, 1)), F.concat(odd(3, 7), digits(6, 2))), F.lit("commit"), 0),
        (F.concat_ws("-", word(1, 3), word(2, 2), digits(3, 4)), word(7, 2), 0),
        (F.concat(word(1, 6), digits(2, 2)), word(7, 2), 0),
        (F.concat(F.initcap(word(1, 2)), F.initcap(word(2, 2)), F.initcap(word(3, 2)), digits(4, 1)), word(7, 1), 0),
        (F.upper(word(1, 6)), word(7, 2), 0),
        (F.concat(F.lit("password="), F.lit("changeme")), F.lit("example"), 0),
        (F.concat(F.lit("token: "), word(1, 3)), word(7, 2), 0),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), strong(1, 64), strong(2, 64), F.lit("\n-----END RSA PRIVATE KEY-----")), word(7, 2), 1),
        (F.concat(*[strong(k, 60) for k in range(1, 7)]), word(7, 2), 1),
        (word(1, 9), word(7, 2), 0),
        (F.concat_ws("/", F.lit(""), odd(1, 3), odd(2, 3), F.concat(odd(3, 7), digits(4, 1)), odd(5, 12), F.concat(odd(6, 6), digits(7, 2))), word(7, 2), 0),
        (F.concat_ws("/", F.lit(""), odd(1, 4), F.concat(odd(3, 5), digits(4, 2)), odd(5, 8), odd(6, 10)), F.lit("see"), 0),
        (F.translate(strong(1, 40), "0123456789", "qwxzvkjyQW"), F.lit("secret key"), 1),
        (F.concat(F.lit("api_key="), F.translate(strong(1, 30), "0123456789", "qwxzvkjyQW")), word(7, 2), 1),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(shapes)))
    pick = lambda at: F.element_at(F.array(*[x[at] if isinstance(x[at], Column) else F.lit(x[at]) for x in shapes]), (kind + 1).cast("int"))
    return spark.range(first, first + rows).select(pick(0).alias("candidate"), pick(1).alias("before"), word(8, 2).alias("after"), pick(2).cast("double").alias("label"))


def fit(
    findings: DataFrame, pieces: list[str] = PIECES, trees: int = TREES, depth: int = DEPTH, seed: int = SEED
) -> RandomForestClassificationModel:
    """The forest; ``findings`` has candidate, before, after and label, and is as
    large as the labelling was: learning sees all of it.  Spark takes the thresholds from
    the square of the number of bins, so there are bins enough for every finding."""
    scratch = Scratch(findings.sparkSession, "findings")
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings, pieces)).select("features", "label")
    ready = scratch.stage(ready, "ready")  # learning reads them several times
    bins = max(BINS, math.isqrt(ready.count()) + 1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, featureSubsetStrategy="onethird").fit(ready)
    scratch.drop()
    return model


def _ends(words: Column, last: bool) -> Column:
    """The last, or the first, two words."""
    return F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)) if last else F.lit(1), F.lit(2)), " ")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, nth, start, candidate, before, after`` of every match in whole texts.

    ``start`` counts code points from 0.  Splitting by the same pattern gives the
    text around each match, so matches close to each other are all found.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # documents without a match stop here, before anything is built for them
    hit = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(F.col("text").rlike(CANDIDATE))
    cut = hit.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("gaps"),
    )
    spots = F.transform(
        F.col("found"),
        lambda x, k: F.struct(
            x.alias("candidate"), F.length(F.get("gaps", k)).alias("gap"),
            _ends(F.split(F.rtrim(F.get("gaps", k)), r"\s+"), True).alias("before"),
            _ends(F.split(F.regexp_replace(F.get("gaps", k + 1), r"^\S{0,2}\s*+", ""), r"\s+", 3), False).alias("after"),
        ),
    )
    flat = cut.select("doc_id", "row", F.posexplode(spots).alias("nth", "s"))
    before = Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("s.gap") + F.length("s.candidate")).over(before) - F.length("s.candidate")
    return flat.select(
        "doc_id", "nth", start.alias("start"), "s.candidate", "s.before", "s.after",
    )


def scan(
    docs: DataFrame, model: RandomForestClassificationModel, pieces: list[str] = PIECES, id_col: str = "doc_id", text_col: str = "text",
    least: float = 0.5,
) -> DataFrame:
    """One row per candidate: ``doc_id, nth, start, length, candidate, before,
    after, probability, is_secret``.

    * Null and empty texts have no candidate; a null id is carried along.
    * Repeated rows give their findings as often as they occur.
    * Empty table, or no match: empty result.  Extra columns are ignored.
    """
    return rated(candidates(docs, id_col, text_col), model, pieces, least)


def rated(found: DataFrame, model: RandomForestClassificationModel, pieces: list[str] = PIECES, least: float = 0.5) -> DataFrame:
    """Candidates with the forest's opinion, as :func:`scan` gives them."""
    found = with_features(found, pieces)
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    chance = vector_to_array("probability")[1]
    return judged.select(
        "doc_id", "nth", "start", F.length("candidate").alias("length"), "candidate", "before", "after",
        chance.alias("probability"), (chance >= least).alias("is_secret"),
    )


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> tuple[RandomForestClassificationModel, list[str]]:
    """A forest and its dictionary, from the words and the findings of all of the
    documents; ``found`` are their candidates where they are known already."""
    pieces = dictionary(docs, text_col)
    found = candidates(docs, id_col, text_col) if found is None else found
    return fit(judged(found, pieces).unionByName(labelled_findings(docs.sparkSession)), pieces), pieces


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of the whole texts of ``documents``.  A fifth of the documents, by
    a checksum of the id, is never learnt from, so that the forest can be tested there;
    all others are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = Scratch(spark, "secrets").stage(candidates(docs), "found")  # texts are searched once
    learnt = ~held_out(F.col("doc_id"))
    return rated(found, *trained(docs.where(learnt), found=found.where(learnt)))
