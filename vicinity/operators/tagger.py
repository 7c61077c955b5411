"""A word tagger fitted from tagged names: a hidden Markov model in built-in expressions.

Fitting is a few aggregates over the tagged words. Tagging looks up the words of
distinct names in the fitted tables and finds the likeliest tag sequence of each
name by the Viterbi recursion, written as an array aggregation. Words that were
not met are judged by their shape.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.functions.text import unify_tags
from vicinity.session import stable

_START, _END = "^", "$"


def words_of(name: Column) -> Column:
    """Words between blanks; an empty or null name has none."""
    return F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")


def shape_of(word: Column) -> Column:
    """What an unknown word is judged by: digits, a single letter, or the last two letters in lower case."""
    return F.when(word.rlike("[0-9]"), "0").when(F.length(word) <= 2, "a").otherwise(F.lower(F.right(word, F.lit(2))))


@dataclass
class Tagger:
    """``words`` and ``shapes`` hold a log probability per tag; ``steps`` those from tag to tag, with start and end."""

    tags: list[str]
    words: DataFrame
    shapes: DataFrame
    unknown: list[float]
    steps: dict[tuple[str, str], float]

    def log_odds(self, names: DataFrame, name: str) -> DataFrame:
        """name and ``odds``: for each of its words the log probabilities per tag, in order."""
        spread = names.select(name, F.posexplode(words_of(F.col(name))).alias("_at", "word")).withColumn("shape", shape_of(F.col("word")))
        # Words of many names are looked up once.
        seen = spread.select("word", "shape").distinct().join(self.words, "word", "left").join(self.shapes, "shape", "left")
        unknown = F.array(*[F.lit(v) for v in self.unknown])
        odds = stable(seen.select("word", F.coalesce("_by_word", "_by_shape", unknown).alias("odds")))
        return spread.join(odds, "word").groupBy(name).agg(F.sort_array(F.collect_list(F.struct("_at", "odds"))).alias("_all")) \
            .select(name, F.transform("_all", lambda w: w.odds).alias("odds"))

    def best_path(self, odds: Column) -> Column:
        """Tags of the likeliest sequence; among equals the tag that comes first in ``tags``."""
        k = range(len(self.tags))
        step = lambda a, b: F.lit(self.steps[a, b])

        def pick(values: list[Column], results: list[Column]) -> tuple[Column, Column]:
            best = F.greatest(*values) if len(values) > 1 else values[0]
            chosen = results[-1]
            for v, r in reversed(list(zip(values[:-1], results[:-1]))):
                chosen = F.when(v == best, r).otherwise(chosen)
            return best, chosen

        def onward(done: Column, word: Column) -> Column:
            scores, paths = [], []
            for j in k:
                values = [done.scores[i] + step(self.tags[i], self.tags[j]) for i in k]
                best, path = pick(values, [done.paths[i] for i in k])
                first = F.size(done.paths[0]) == 0
                scores.append(F.when(first, step(_START, self.tags[j])).otherwise(best) + word[j])
                paths.append(F.concat(path, F.array(F.lit(self.tags[j]))))
            return F.struct(F.array(*scores).alias("scores"), F.array(*paths).alias("paths"))

        nothing = F.array().cast("array<string>")
        begin = F.struct(F.array(*[F.lit(0.0) for _ in k]).alias("scores"), F.array(*[nothing for _ in k]).alias("paths"))
        return F.aggregate(odds, begin, onward, lambda done: pick(
            [done.scores[i] + step(self.tags[i], _END) for i in k], [done.paths[i] for i in k])[1])

    def tag(self, df: DataFrame, name: str, into: str = "tags") -> DataFrame:
        """``df`` with the word tags of a name; names without words have none."""
        names = df.select(F.col(name).alias("_name")).where(F.size(words_of(F.col(name))) > 0).distinct()
        tagged = self.log_odds(names, "_name").select("_name", self.best_path(F.col("odds")).alias(into))
        return df.join(tagged, F.col(name) == F.col("_name"), "left").drop("_name")

    def entities(self, df: DataFrame, name: str, kinds: tuple[str, ...] = ("ORGANIZATION", "PERSON"), into: str = "entity") -> DataFrame:
        """``df`` with one tag per name: where at least two words are tagged and all tagged words agree."""
        tagged = self.tag(df, name, "_tags")
        one = unify_tags(F.col("_tags"))
        return tagged.withColumn(into, F.when(one.isin(*kinds), one)).drop("_tags")


def fit_tagger(examples: DataFrame, name: str, tags: str, strength: float = 1.0) -> Tagger:
    """Tagger from names with one tag per word (``tags``: array of the same length; others are left out).

    A word's probability under a tag leans on its shape's, by ``strength``
    occurrences; counts of shapes and steps start at one. Tags are few; the word and shape tables stay tables.
    """
    rows = examples.select(words_of(F.col(name)).alias("w"), F.col(tags).alias("t")).where("size(w) = size(t) AND size(w) > 0")
    pairs = F.zip_with("w", "t", lambda w, t: F.struct(w.alias("word"), t.alias("tag")))
    tokens = stable(rows.select(F.explode(pairs).alias("p")).select("p.*", shape_of(F.col("p.word")).alias("shape"))
                    .groupBy("word", "shape", "tag").agg(F.count(F.lit(1)).alias("n")))
    per_tag = {r["tag"]: r["n"] for r in tokens.groupBy("tag").agg(F.sum("n").alias("n")).collect()}
    known = sorted(per_tag)
    if not known:
        raise ValueError("no tagged names to learn from")
    sums = [F.coalesce(F.sum(F.when(F.col("tag") == t, F.col("n"))), F.lit(0)).alias(f"_{i}") for i, t in enumerate(known)]
    shapes = tokens.groupBy("shape").agg(*sums)
    kinds = shapes.count()
    chance = [(F.col(f"_{i}") + 1.0) / float(per_tag[t] + kinds + 1) for i, t in enumerate(known)]
    shapes = stable(shapes.select("shape", F.array(*chance).alias("_chance")))
    unknown = [1.0 / (per_tag[t] + kinds + 1) for t in known]
    words = tokens.groupBy("word", "shape").agg(*sums).join(shapes, "shape")
    by_word = [F.log((F.col(f"_{i}") + strength * F.col("_chance")[i]) / (per_tag[t] + strength)) for i, t in enumerate(known)]
    lean = lambda i, t, p: F.log(strength * p / (per_tag[t] + strength))
    seen = rows.select(F.explode(F.zip_with(F.concat(F.array(F.lit(_START)), "t"), F.concat("t", F.array(F.lit(_END))),
                                            lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("s")).groupBy("s.a", "s.b").count().collect()
    steps = {(r["a"], r["b"]): r["count"] for r in seen}
    total = {a: sum(n for (x, _), n in steps.items() if x == a) for a in [_START, *known]}
    smooth = {(a, b): math.log((steps.get((a, b), 0) + 1) / (total[a] + len(known) + 1)) for a in [_START, *known] for b in [*known, _END]}
    return Tagger(
        known, stable(words.select("word", F.array(*by_word).alias("_by_word"))),
        shapes.select("shape", F.array(*[lean(i, t, F.col("_chance")[i]) for i, t in enumerate(known)]).alias("_by_shape")),
        [math.log(strength * p / (per_tag[t] + strength)) for t, p in zip(known, unknown)], smooth)
