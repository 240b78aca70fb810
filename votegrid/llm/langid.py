"""Language identification by word-first backoff.

A known word scores its log frequency in each language.  An unseen word falls back
to its longest known character n-grams, then to shorter ones, down to letters.
A document's language is the one with the highest mean score.

Counting covers a bounded number of labelled documents of each language; every word
and n-gram that occurs in them is in the model.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votegrid.llm.common import held_out, python_ready
from votegrid.storage import Scratch


#: The first letter of each character's Unicode category.
_KINDS = "".join(unicodedata.category(chr(k))[0] for k in range(sys.maxunicode + 1))


def _class_of(kinds: str) -> str:
    """The ranges of all characters whose Unicode category begins with one of ``kinds``."""
    return "".join(f"{chr(m.start())}-{chr(m.end() - 1)}" for m in re.finditer(f"[{kinds}]+", _KINDS))


#: A word: a letter, then letters and the marks that belong to them.
LETTERS = re.compile(f"[{_class_of('L')}][{_class_of('LM')}]*")
_PLAIN = re.compile("[a-z]+")
#: Labelled documents counted for each language, about: the bound of the model's size.
SAMPLE_DOCS = 2_000
GRAMS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
#: A level of backoff counts a little less than the one above it.
BACKOFF = 0.7
UNKNOWN = "und"


def word_counts(text: str | None) -> Counter:
    text = (text or "").lower()
    return Counter((_PLAIN if text.isascii() else LETTERS).findall(text))


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word between its boundary marks; single letters bare."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


@dataclass
class Table:
    """Log frequencies of one level: a row of ``scores`` per key."""

    index: dict[str, int]
    scores: np.ndarray


@dataclass
class Model:
    """Level 0 holds words, the others n-grams of each length of ``GRAMS``.

    Scores are log frequencies less their mean over the languages: 0 favours none.
    """

    languages: list[str]
    prior: np.ndarray
    levels: list[Table]

    def backed_off(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words, a row each: their longest n-grams that are known.

        Words go level by level together, so that a level costs one sum."""
        scores = np.zeros((len(words), len(self.languages)), np.float32)
        left, weight = list(range(len(words))), 1.0
        for n, table in zip(GRAMS, self.levels[1:], strict=True):
            weight *= BACKOFF
            rows, starts, found, rest = [], [], [], []
            index = table.index
            for k in left:
                known = [index[g] for g in grams(words[k], n) if g in index]
                if known:
                    starts.append(len(rows))
                    rows += known
                    found.append(k)
                else:
                    rest.append(k)
            if found:
                sums = np.add.reduceat(table.scores[rows], starts, axis=0)
                sizes = np.diff([*starts, len(rows)])
                scores[found] = weight * sums / sizes[:, None]
            left = rest
            if not left:
                break
        return scores

    def predict(self, texts: list[Counter]) -> list[tuple[str, float]]:
        """Language and its share of belief for each text's word counts; no letters:
        (``und``, 0)."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        words = self.levels[0]
        unseen = list(dict.fromkeys(w for counts in texts for w in counts if w not in words.index))
        row = {w: len(words.index) + k for k, w in enumerate(unseen)}
        scores = np.concatenate([words.scores, self.backed_off(unseen)]) if unseen else words.scores
        known, out = words.index, []
        for counts in texts:
            if not counts:
                out.append((UNKNOWN, 0.0))
                continue
            at = [known[w] if w in known else row[w] for w in counts]
            times = np.fromiter(counts.values(), np.float64, len(counts))
            belief = self.prior + times @ scores[at]
            belief = np.exp(belief - belief.max())
            best = int(belief.argmax())
            out.append((self.languages[best], float(belief[best] / belief.sum())))
        return out


def _table(keys: list[str], counts: np.ndarray) -> Table:
    """From a row of counts by language for each key."""
    whole = np.maximum(counts.sum(axis=0), 1.0)
    # one floor for all languages: not to have seen a word says least where little was seen
    scores = np.log(counts / whole + SMOOTHING / whole.max(initial=1.0))
    scores -= scores.mean(axis=1, keepdims=True)
    return Table({key: k for k, key in enumerate(keys)}, scores.astype(np.float32))


def _tables(found: pa.Table, languages: list[str], levels: int) -> list[Table]:
    """A table for each level of ``level, lang, key, n`` rows, in arrays throughout."""
    level = found["level"].to_numpy()
    lang = np.searchsorted(np.array(languages, object), found["lang"].to_numpy(zero_copy_only=False))
    tables = []
    for k in range(levels):
        here = np.flatnonzero(level == k)
        coded = found["key"].take(pa.array(here)).combine_chunks().dictionary_encode()
        keys = coded.dictionary.to_pylist()
        counts = np.zeros((len(keys), len(languages)))
        np.add.at(counts, (coded.indices.to_numpy(), lang[here]), found["n"].to_numpy()[here])
        tables.append(_table(keys, counts))
    return tables


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    sample_docs: int = SAMPLE_DOCS,
    scratch: Scratch | None = None,
) -> Model:
    """Learn from rows with a language.  Where a language has more than
    ``sample_docs`` rows, a share chosen by a hash of the id is counted; all words
    and n-grams of these reach the driver and, in the model, every worker."""
    spark = docs.sparkSession
    python_ready(spark)
    scratch = scratch or Scratch(spark, "langid")
    rows = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id")
    )
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(0), [])
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_docs / sizes[k]))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(lang, Counter()).update(word_counts(text.as_py()))
            flat = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            columns = list(zip(*flat, strict=True)) or [()] * 3
            types = [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "key", "n"])

    words = scratch.stage(
        sample.select("lang", "text").mapInArrow(count, "lang string, key string, n long")
        .groupBy("lang", "key").agg(F.sum("n").alias("n")),
        "words",
    )
    counted = words.select(F.lit(0).alias("level"), "lang", "key", "n")
    for k, n in enumerate(GRAMS, 1):
        marked = F.concat(F.lit("^"), "key", F.lit("$")) if n > 1 else F.col("key")
        spots = F.expr(f"transform(sequence(1, length(marked) - {n - 1}), at -> substring(marked, at, {n}))")
        counted = counted.unionByName(
            words.withColumn("marked", marked).where(F.length("marked") >= n).select(F.lit(k).alias("level"), "lang", F.explode(spots).alias("key"), "n")
        )
    found = counted.groupBy("level", "lang", "key").agg(F.sum("n").alias("n")).toArrow()
    scratch.keep()
    prior = np.log(np.array([sizes[x] for x in languages], dtype=float) / sum(sizes.values()))
    return Model(languages, prior, _tables(found, languages, 1 + len(GRAMS)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score``.

    * Null, empty and letterless texts: ``und`` with score 0; a model that has
      seen no language gives ``und`` too.
    * A text none of whose letters the model knows gets the most frequent
      language and its share.  Ties: the first language in alphabetical order.
    * Repeated rows and null ids are carried along; an empty table gives an empty
      result; extra columns are ignored.
    """
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample learnt from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict([word_counts(x.as_py()) for x in batch.column(1)])
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``; learnt from the documents not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
