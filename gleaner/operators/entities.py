"""Names of several words, typed entities with their confidence, relations between all names of a sentence, and pronouns.

Sentences are split into words and punctuation inside the row, so only names, phrases that tell a
relation and pronouns leave it. Null texts have none of them; repeated rows count each.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators.relations import PATTERNS, RELATIONS

#: Words that are no entities, and the most words of one.
STOP_ENTITIES = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were"]
MOST_WORDS = 5
#: What follows a person's name in its stead.
PRONOUNS = ["he", "she", "they", "who", "him", "her", "his", "hers", "their"]
#: Confidence of an entity by what found it.
CONFIDENCE = {"phrase": 0.9, "pattern": 0.8, "name": 0.7}
#: Relation, words that fill the gap between source and target, and those between target and source; each is one choice from every list.
BE, THE = ["is", "was", "are", "were"], ["", "a", "an", "the"]
SEMANTIC = [
    ("IS_A", [[BE, THE], [BE, ["known as", "called"]]], []),
    ("PART_OF", [[["is", "was"], ["part of", "in", "within"]]], [[["contains", "includes", "has"]]]),
    ("LOCATED_IN", [[["is", "was"], ["in", "at", "located in", "situated in"]], [["of", "from"]]], []),
    ("RELATED_TO", [[["and", "with", "related to", "associated with"]]], []),
    ("FATHER_OF", [[["is", "was"], ["", "the"], ["father of", "dad of"]]], [[["is", "was"], ["", "the"], ["son of", "child of"]]]),
    ("MOTHER_OF", [[["is", "was"], ["", "the"], ["mother of", "mom of"]]], [[["is", "was"], ["", "the"], ["daughter of", "child of"]]]),
    ("RULED", [[["ruled", "governed", "was king of", "was queen of"]]], [[["was ruled by", "was governed by"]]]),
    ("BORN_IN", [[["was born in", "born in", "from"]]], []),
    ("DEFEATED", [[["defeated", "killed", "destroyed", "conquered"]]], []),
    ("MARRIED_TO", [[["married", "wed"]]], []),
]
#: A phrase is seen so often, and its words come together so much more often than by chance (log).
LEAST_SEEN, LEAST_PMI = 3, 1.0
#: Phrases up to this many are broadcast; more are joined by shuffle.
BROADCAST_PHRASES = 500_000
NAME = r"^\p{Lu}\p{L}+$"
WORD_OR_MARK = r"\p{L}+|[^\p{L}\s]+"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_PHRASES else df


def is_name(word: Column) -> Column:
    return F.rlike(word, F.lit(NAME)) & ~F.lower(word).isin(STOP_ENTITIES)


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, sentence, w): words and runs of marks, by sentence. docs is a scan or a cut, so that row tells repeated rows apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), r"[.!?\n]+").alias("s")).withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", "doc_id", F.posexplode("s").alias("sentence", "s")).select("row", "doc_id", "sentence", F.regexp_extract_all("s", F.lit(WORD_OR_MARK), F.lit(0)).alias("w"))


def name_words(of_sentences: DataFrame) -> DataFrame:
    """(row, doc_id, sentence, pos, word, after): words that are names, each with the one next to it if that is a name too."""
    after = lambda i: F.get("w", i + 1)
    marked = F.transform("w", lambda x, i: F.when(is_name(x), F.struct(i.alias("pos"), x.alias("word"), F.when(is_name(after(i)), after(i)).alias("after"))))
    return of_sentences.select("row", "doc_id", "sentence", F.inline(F.array_compact(marked)))


def phrases(names: DataFrame, least: int = LEAST_SEEN, least_pmi: float = LEAST_PMI) -> DataFrame:
    """(x, y, n, pmi): names that stand next to each other often, and more so than by chance."""
    total = names.count()
    one = names.groupBy("word").agg(F.count("*").alias("n"))
    two = names.where("after is not null").groupBy(F.col("word").alias("x"), F.col("after").alias("y")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    of = lambda c, name: one.select(F.col("word").alias(c), F.col("n").alias(name))
    met = _small(two).join(of("x", "n_x"), "x")
    return _small(met).join(of("y", "n_y"), "y").select("x", "y", "n", F.round(F.log(F.col("n") * F.lit(float(total)) / (F.col("n_x") * F.col("n_y"))), 6).alias("pmi")).where(F.col("pmi") >= least_pmi)


def intervals(names: DataFrame, known: DataFrame) -> DataFrame:
    """(row, doc_id, sentence, start, stop, entity, source): runs of names each two of which are a phrase, up to MOST_WORDS words, and the names outside them; stop is the place after it."""
    pairs = names.where("after is not null").join(_small(known.select(F.col("x").alias("word"), F.col("y").alias("after"))), ["word", "after"])
    # only what belongs to a phrase is brought together by sentence
    line = W.partitionBy("row", "sentence").orderBy("pos")
    runs = pairs.withColumn("run", F.col("pos") - F.row_number().over(line)).groupBy("row", "doc_id", "sentence", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 2).alias("stop"), F.array_sort(F.collect_list(F.struct("pos", "word", "after"))).alias("p"))
    text = F.concat_ws(" ", F.col("p.word"), F.element_at("p", -1)["after"])
    long = runs.where(F.col("stop") - F.col("start") <= MOST_WORDS).select("row", "doc_id", "sentence", "start", "stop", text.alias("entity"), F.lit("phrase").alias("source"))
    inside = long.select("row", "sentence", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))
    single = names.join(inside, ["row", "sentence", "pos"], "left_anti").select("row", "doc_id", "sentence", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"), F.col("word").alias("entity"), F.lit("name").alias("source"))
    return long.unionByName(single)


def typed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, entity, type, source, confidence, n): phrases, typed patterns and single names; what several find goes by the surest."""
    named = found.groupBy("doc_id", F.col("entity"), "source").agg(F.count("*").alias("n")).withColumn("type", F.when(F.col("source") == "phrase", "COMPOUND").otherwise("NAME")).withColumn("k", F.lit(-1))

    def of(k: int, kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?i)" + pattern), F.lit(0))
        return F.transform(hits, lambda x: F.struct(F.trim(F.regexp_replace(x, r"\s+", " ")).alias("entity"), F.lit(kind).alias("type"), F.lit(k).alias("k")))

    matched = docs.select("doc_id", F.inline(F.concat(*[of(k, kind, p) for k, (kind, p) in enumerate(PATTERNS)]))).groupBy("doc_id", "entity", "type", "k").agg(F.count("*").alias("n")).withColumn("source", F.lit("pattern"))
    sure = F.lit(0.0)
    for source, confidence in CONFIDENCE.items():
        sure = F.when(F.col("source") == source, F.lit(confidence)).otherwise(sure)
    rows = named.unionByName(matched).withColumn("confidence", sure).withColumn("entity", F.lower("entity"))
    best = rows.groupBy("doc_id", "entity").agg(F.max(F.struct("confidence", "k", "type", "source")).alias("best"), F.sum("n").alias("n"))
    return best.select("doc_id", "entity", "best.type", "best.source", "best.confidence", "n")


def statistics(entities: DataFrame) -> DataFrame:
    """(type, n_entities, n_docs, mentions, mean_confidence, n_sure): of typed()."""
    return entities.groupBy("type").agg(F.count_distinct("entity").alias("n_entities"), F.count_distinct("doc_id").alias("n_docs"), F.sum("n").alias("mentions"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("confidence") >= 0.8).alias("n_sure"))


def _fillings(lists: list) -> list[str]:
    """Every choice of one from each list, as words."""
    return sorted({" ".join(" ".join(c).split()) for options in lists for c in product(*options)})


def triggers(of_sentences: DataFrame, phrases: list[tuple[str, bool, str]]) -> DataFrame:
    """(row, sentence, relation, forth, at, end): places of phrases (relation, from source to target or back, words); end is the place after it."""
    by_size: dict[int, set] = {}
    for _, _, words in phrases:
        by_size.setdefault(len(words.split()), set()).add(words)

    def spots(size: int, held: list[str]) -> Column:
        here = lambda i: F.array_join(F.slice("low", i + 1, F.lit(size)), " ")
        row = lambda i: F.struct(here(i).alias("words"), i.alias("at"), (i + size).alias("end"))
        # only where a phrase's first word stands are its words put together
        hit = lambda x, i: F.when(x.isin(sorted({w.split()[0] for w in held})), F.when(here(i).isin(held) & (i + size <= F.size("low")), row(i)))
        return F.array_compact(F.transform("low", hit))

    table = of_sentences.sparkSession.createDataFrame(phrases, "relation string, forth boolean, words string")
    low = of_sentences.select("row", "sentence", F.transform("w", lambda x: F.lower(x)).alias("low"))
    return low.select("row", "sentence", F.inline(F.concat(*[spots(size, sorted(held)) for size, held in sorted(by_size.items())]))).join(F.broadcast(table), "words").select("row", "sentence", "relation", "forth", "at", "end")  # a constant table


def related_across(found: DataFrame, told: DataFrame) -> DataFrame:
    """(source, target, relation, n, first_doc): names of a sentence with a phrase anywhere between them; n counts sentences.

    Going along a sentence, each name gets the end of the first phrase after it. Of a node only the earliest such
    end and the last place matter, so work grows with names and phrases, and with what is found.
    """
    names = found.select("row", "doc_id", "sentence", "start", "stop", F.lower("entity").alias("node"))
    kinds = told.select("row", "sentence", "relation", "forth").distinct()
    own = ["row", "sentence", "relation", "forth"]
    here = names.join(kinds, ["row", "sentence"]).select(*own, "doc_id", "node", "start", F.col("stop").alias("place"), F.lit(None).cast("int").alias("end"))
    line = here.unionByName(told.select(*own, F.lit(None).cast(found.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("string").alias("node"), F.col("at").alias("start"), F.col("at").alias("place"), "end"))
    # at the same place a name stands before a phrase
    after = W.partitionBy(*own).orderBy(F.desc("place"), F.desc_nulls_last("end"))
    swept = line.withColumn("next", F.min("end").over(after.rowsBetween(W.unboundedPreceding, 0))).where("node is not null")
    ends = swept.groupBy(*own, "doc_id", "node").agg(F.min("next").alias("next"), F.max("start").alias("last"))
    left = ends.where("next is not null").select(*own, "doc_id", F.col("node").alias("x"), "next")
    right = ends.select(*own, F.col("node").alias("y"), "last")
    met = left.join(right, own).where("x <> y and last >= next")
    pick = lambda a, b: F.when(F.col("forth"), F.col(a)).otherwise(F.col(b))
    pairs = met.select("row", "sentence", "doc_id", "relation", pick("x", "y").alias("source"), pick("y", "x").alias("target")).distinct()
    return pairs.groupBy("source", "target", "relation").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def related_directly(found: DataFrame, told: DataFrame) -> DataFrame:
    """(source, target, relation, n, first_doc): names with nothing but a phrase between them."""
    names = found.select("row", "doc_id", "sentence", "start", "stop", F.lower("entity").alias("node"))
    left = names.select("row", "sentence", "doc_id", F.col("stop").alias("at"), F.col("node").alias("x"))
    right = names.select("row", "sentence", F.col("start").alias("end"), F.col("node").alias("y"))
    met = told.join(left, ["row", "sentence", "at"]).join(right, ["row", "sentence", "end"]).where("x <> y")
    pick = lambda a, b: F.when(F.col("forth"), F.col(a)).otherwise(F.col(b))
    pairs = met.select("row", "sentence", "doc_id", "relation", pick("x", "y").alias("source"), pick("y", "x").alias("target")).distinct()
    return pairs.groupBy("source", "target", "relation").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


ACROSS = [(r, way, p) for r, forth, back in RELATIONS for way, ps in ((True, forth), (False, back)) for p in ps]
DIRECT = [(r, way, p) for r, forth, back in SEMANTIC for way, ps in ((True, _fillings(forth)), (False, _fillings(back))) for p in ps]


def resolved(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, sentence, pos, pronoun, entity): each pronoun of a conversation with the name before it, in this turn or an earlier one; null if there is none.

    Only names and pronouns are brought together by conversation, not texts.
    """
    rows = turns.select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+").alias("s"))
    worded = rows.select("conv_id", "turn", F.posexplode("s").alias("sentence", "s")).select("conv_id", "turn", "sentence", F.regexp_extract_all("s", F.lit(WORD_OR_MARK), F.lit(0)).alias("w"))
    kind = lambda x, i: F.when(F.lower(x).isin(PRONOUNS), F.struct(i.alias("pos"), x.alias("pronoun"), F.lit(None).cast("string").alias("name"))).when(is_name(x), F.struct(i.alias("pos"), F.lit(None).cast("string").alias("pronoun"), x.alias("name")))
    told = worded.select("conv_id", "turn", "sentence", F.inline(F.array_compact(F.transform("w", kind))))
    before = W.partitionBy("conv_id").orderBy("turn", "sentence", "pos").rowsBetween(W.unboundedPreceding, -1)
    return told.withColumn("entity", F.last("name", ignorenulls=True).over(before)).where("pronoun is not null").select("conv_id", "turn", "sentence", "pos", "pronoun", "entity")
