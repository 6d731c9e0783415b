"""Entities and relations: annotation documents, plug-in providers, and dictionary and rule providers that need no model.

A provider is a function of a DataFrame (pmid, text) that returns entities (pmid, entity_type, entity_seq, text,
confidence, start, end); models run inside it by Arrow batches (``batched``). The same goes for relation providers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.text import ENTITY_TYPES, RELATION_OF_ANNOTATION, RELATION_TYPES, assertion_status, find_offset, lookup, mark_entities, normalize_relation, parse_model_json, reply_status, resolve_concept
from helixmill.operators.graph import pairs_of
from helixmill.session import cut

DEFAULT_TYPES = ("DISEASE", "DRUG", "GENE", "MUTATION")
CONFIDENCE = {"openmed": 0.7, "gliner": 0.7, "zero_shot": 0.5, "relations": 0.5}
MAX_PAIRS = 100
CONTRAST_LABELS = ("date", "location", "number", "organization", "other", "person")
ENTITY_SCHEMA = "pmid string, entity_type string, entity_seq int, text string, confidence double, start int, end int"


# --- annotation documents ---


def document_entities(documents: DataFrame, keep: tuple[str, ...] = DEFAULT_TYPES) -> DataFrame:
    """Entities of annotation documents (see sources.annotations): known types, texts of two letters or more, each text
    once by article and type, the first annotation's place and concept."""
    a = documents.select(F.col("id").alias("pmid"), F.posexplode("passages").alias("p", "passage")).select("pmid", "p", F.posexplode("passage.annotations").alias("q", "a"))
    a = a.select("pmid", F.struct("p", "q").alias("seq"), F.trim("a.text").alias("text"), lookup(F.col("a.infons.type"), ENTITY_TYPES).alias("entity_type"), F.trim(F.coalesce(F.nullif(F.col("a.infons.identifier"), F.lit("")), F.col("a.infons.id"))).alias("identifier"), F.try_element_at("a.locations", F.lit(1)).alias("at"))
    a = a.filter(F.col("entity_type").isin(*keep) & (F.length("text") >= 2))
    k = F.row_number().over(Window.partitionBy("pmid", "entity_type", F.lower("text")).orderBy("seq"))
    a = a.withColumn("k", k).filter("k = 1").withColumn("c", resolve_concept(F.col("identifier"), F.col("entity_type")))
    seq = F.row_number().over(Window.partitionBy("pmid", "entity_type").orderBy("seq")) - 1
    return a.select("pmid", "entity_type", seq.alias("entity_seq"), "text", F.lit(1.0).alias("confidence"), F.col("at.offset").alias("start"), (F.col("at.offset") + F.col("at.length")).alias("end"), "c.concept_id", "c.concept_source")


def document_relations(documents: DataFrame) -> DataFrame:
    """(pmid, triplet_seq, subject, relation, object) of annotation documents.

    An end is named by role, or by annotation id or identifier, or by reference, in that order; the next way counts
    where one leaves an end open. Unknown relations and those of a text with itself are left out.
    """
    flat = F.flatten(F.transform("passages", lambda p: F.coalesce(p["annotations"], F.array().cast(documents.schema["passages"].dataType.elementType["annotations"].dataType))))
    named = F.filter(F.transform(flat, lambda a: F.named_struct(F.lit("id"), F.coalesce(a["id"], F.lit("")), F.lit("text"), F.trim(a["text"]), F.lit("identifier"), F.trim(F.coalesce(F.nullif(a["infons"]["identifier"], F.lit("")), a["infons"]["id"], F.lit(""))))), lambda a: a["text"] != "")
    d = documents.select(F.col("id").alias("pmid"), named.alias("named"), F.posexplode("relations").alias("triplet_seq", "r"))

    def text_of(field: str, value: Column) -> Column:
        """The text of the last annotation that has the value."""
        hits = F.filter("named", lambda a: (a[field] == value) & (value != "") & (value != "None"))
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["text"], F.lit(""))

    def blank(c: Column) -> Column:
        return F.coalesce(F.trim(c), F.lit(""))

    i = F.col("r.infons")

    def by_role(role: str) -> Column:
        name = blank(i[role]["normalized_name"])
        return F.when(name != "", name).otherwise(text_of("identifier", blank(i[role]["identifier"])))

    def by_id(field: str) -> Column:
        t = text_of("id", blank(i[field]))
        return F.when(t != "", t).otherwise(text_of("identifier", blank(i[field])))

    def by_ref(n: int) -> Column:
        return text_of("id", blank(F.try_element_at(F.col("r.nodes"), F.lit(n))["refid"]))

    roles = i["role1"].isNotNull() & i["role2"].isNotNull()
    d = d.withColumns({"s": F.when(roles, by_role("role1")).otherwise(""), "o": F.when(roles, by_role("role2")).otherwise("")})
    for a, b, there in ((by_id("entity1"), by_id("entity2"), (blank(i["entity1"]) != "") & (blank(i["entity2"]) != "")), (by_ref(1), by_ref(2), F.size("r.nodes") >= 2)):
        open_end = ((F.col("s") == "") | (F.col("o") == "")) & F.coalesce(there, F.lit(False))
        d = d.withColumns({"s": F.when(open_end, a).otherwise(F.col("s")), "o": F.when(open_end, b).otherwise(F.col("o"))})
    d = d.withColumn("relation", lookup(i["type"], RELATION_OF_ANNOTATION)).filter("relation is not null and s <> '' and o <> '' and lower(s) <> lower(o)")
    return d.select("pmid", "triplet_seq", F.col("s").alias("subject"), "relation", F.col("o").alias("object"))


def fill_missing(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Every requested article, in its order, with its entities or an error that says there are none."""
    grouped = found.groupBy("pmid").agg(F.sort_array(F.collect_list(F.struct("entity_type", "entity_seq", "text"))).alias("entities"))
    return requested.join(grouped, "pmid", "left").select("pmid", "position", "entities", F.when(F.col("entities").isNull(), "no annotations available").alias("error"))


# --- providers ---


def article_text(title: Column, abstract: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(title, F.lit("")), F.nullif(abstract, F.lit("")))


def batched(predict: Callable[[list[str]], list[list[dict]]]) -> Callable[[DataFrame], DataFrame]:
    """A provider of a model: texts to lists of {entity_type, text, confidence, start, end}; a text that fails in a
    batch is tried alone and then has none."""

    def one(text: str) -> list[dict]:
        try:
            return predict([text])[0]
        except Exception:  # noqa: BLE001 - a model may raise anything
            return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].fillna("").tolist()
            try:
                found = predict(texts)
            except Exception:  # noqa: BLE001
                found = [one(t) for t in texts]
            rows = [(p, e["entity_type"], k, e["text"], e.get("confidence"), e.get("start"), e.get("end")) for p, es in zip(b["pmid"], found) for k, e in enumerate(es)]
            yield pd.DataFrame(rows, columns=["pmid", "entity_type", "entity_seq", "text", "confidence", "start", "end"])

    return lambda articles: articles.select("pmid", "text").mapInPandas(run, ENTITY_SCHEMA)


def dictionary_provider(gazetteer: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A provider that finds the terms of a table (term, entity_type) as whole words: texts are exploded into spans of one
    to as many words as the longest term has, and meet the terms by an equal join; no text meets every term."""

    def find(articles: DataFrame) -> DataFrame:
        terms = gazetteer.select(F.lower(F.trim("term")).alias("key"), "entity_type").distinct()
        longest = terms.agg(F.max(F.size(F.split("key", " +")))).first()[0] or 0
        if not longest:
            return articles.sparkSession.createDataFrame([], ENTITY_SCHEMA)
        words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\-]*"), 0)
        w = articles.select("pmid", "text", F.posexplode(words).alias("i", "w"), words.alias("ws"))
        spans = w.select("pmid", "text", "i", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("ws") - F.col("i"))), lambda n: F.array_join(F.slice("ws", F.col("i") + 1, n), " "))).alias("span"))
        hit = spans.withColumn("key", F.lower("span")).join(terms, "key")
        start = F.instr(F.lower("text"), F.col("key")) - 1
        k = F.row_number().over(Window.partitionBy("pmid", "entity_type", "key").orderBy("i"))
        first = hit.withColumn("k", k).filter("k = 1").withColumn("start", start)
        seq = F.row_number().over(Window.partitionBy("pmid", "entity_type").orderBy("i", "key")) - 1
        return first.select("pmid", "entity_type", seq.cast("int").alias("entity_seq"), F.col("span").alias("text"), F.lit(1.0).alias("confidence"), F.when(F.col("start") >= 0, F.col("start")).cast("int").alias("start"), F.when(F.col("start") >= 0, F.col("start") + F.length("key")).cast("int").alias("end"))

    return find


class Providers:
    """Providers by name; "dictionary" needs no model."""

    def __init__(self, default: str | None = None, **providers: Callable[[DataFrame], DataFrame]):
        self._by_name, self._default = dict(providers), default

    def register(self, name: str, provider: Callable[[DataFrame], DataFrame]) -> None:
        self._by_name[name] = provider

    def extract(self, name: str, articles: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
        """Entities of the types asked for; a name that isn't registered stands for the default, and is an error without one."""
        name = name if name in self._by_name else self._default or name
        if name not in self._by_name:
            raise KeyError(f"no provider {name!r}; there are {sorted(self._by_name)}")
        found = self._by_name[name](articles).filter(F.trim("text") != "")
        least = CONFIDENCE.get(name)
        found = found if least is None else found.filter(F.col("confidence") >= least)
        return found if not types else found.filter(F.col("entity_type").isin(*types))


def with_fallback(provider: Callable[[DataFrame], DataFrame], other: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A provider that takes the articles of which the first finds nothing, or fails with, to another."""

    def find(articles: DataFrame) -> DataFrame:
        found = cut(provider(articles))
        return found.unionByName(other(articles.join(found.select("pmid").distinct(), "pmid", "left_anti")))

    return find


def with_assertions(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """Entities with the assertion status that the sentence says in which each stands (articles: pmid, text)."""
    known = entities.join(articles.select("pmid", F.col("text").alias("__text")), "pmid", "left")
    return known.withColumn("assertion_status", assertion_status(F.col("__text"), F.col("text"))).drop("__text")


def valid_types(asked: list[str], known: tuple[str, ...], strict: bool = False) -> list[str]:
    """The known of the types asked for; strict: an unknown one is an error; else all where none is left."""
    found = [t.upper() for t in asked]
    unknown = [t for t in found if t not in known]
    if strict and unknown:
        raise ValueError(f"unknown entity types: {', '.join(unknown)}")
    return [t for t in found if t in known] or list(known)


def without_contrast(entities: DataFrame) -> DataFrame:
    """Zero-shot results without the labels that were only there to draw off what isn't meant."""
    return entities.filter(~F.lower("entity_type").isin(*CONTRAST_LABELS))


def entity_pairs(entities: DataFrame, limit: int | None = MAX_PAIRS) -> DataFrame:
    """Pairs of an article's entities in order of combination, the first ``limit``."""
    return pairs_of(entities.withColumn("__o", F.struct("entity_type", "entity_seq")), "pmid", "__o", limit)


RELATION_SCHEMA = "pmid string, pair_no int, subject string, object string, relation string, confidence double"


def pair_relations(predict: Callable[[list[str]], list[tuple[str, float]]]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A provider of relations by a model that scores pairs: of an article's first ``MAX_PAIRS`` pairs of entities, marked in
    its text, ``predict`` gives (relation, confidence) for each marked text. What is below the least confidence, or no
    relation, or about texts that don't stand in the article, is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = predict(b["marked"].tolist()) if len(b) else []
            yield b[["pmid", "pair_no", "subject", "object"]].assign(relation=[r for r, _ in said], confidence=[float(c) for _, c in said])

    def find(entities: DataFrame, articles: DataFrame) -> DataFrame:
        pairs = entity_pairs(entities).select("pmid", F.col("pair_no").cast("int"), F.col("text_a").alias("subject"), F.col("text_b").alias("object"))
        t = pairs.join(articles.select("pmid", "text"), "pmid")
        t = t.withColumns({"i": find_offset(F.col("text"), F.col("subject")), "j": find_offset(F.col("text"), F.col("object"))}).filter("i is not null and j is not null and i <> j")
        marked = mark_entities(F.col("text"), F.col("i"), F.col("i") + F.length("subject"), F.col("j"), F.col("j") + F.length("object"))
        return accept_relations(t.select("pmid", "pair_no", "subject", "object", marked.alias("marked")).mapInPandas(run, RELATION_SCHEMA))

    return find


MAX_PROMPT_ENTITIES, MAX_PROMPT_CHARS = 30, 1500


def relation_prompts(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """(pmid, prompt, status) for a model that writes relations as JSON: the first 30 entities and 1,500 characters; articles
    of fewer than two entities are skipped and have no prompt."""
    e = entities.groupBy("pmid").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("entity_type", "entity_seq", "text"))), lambda x: F.concat(x["text"], F.lit(" ("), x["entity_type"], F.lit(")"))), 1, MAX_PROMPT_ENTITIES).alias("e"))
    known = articles.select("pmid", "text").join(e, "pmid", "left")
    enough = F.coalesce(F.size("e") >= 2, F.lit(False)) & (F.coalesce("text", F.lit("")) != "")
    prompt = F.concat(F.lit("Entities: "), F.array_join("e", ", "), F.lit("\nRelations: " + ", ".join(RELATION_TYPES) + "\nText: "), F.left("text", F.lit(MAX_PROMPT_CHARS)), F.lit('\nAnswer as JSON: {"relations": [{"subject": "", "relation": "", "object": ""}]}'))
    return known.select("pmid", F.when(enough, prompt).alias("prompt"), F.when(enough, "ok").otherwise("skipped").alias("status"))


def relations_of_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of replies (pmid, reply): triplets of known relations, and (pmid, status): ok, empty or error."""
    parsed = parse_model_json(F.col("reply"), "relations array<struct<subject: string, relation: string, object: string>>")["relations"]
    t = replies.select("pmid", F.posexplode(parsed).alias("triplet_seq", "r")).select("pmid", "triplet_seq", "r.*").filter("subject is not null and relation is not null and object is not null")
    return known_relations(t)[0], replies.select("pmid", reply_status(F.col("reply")).alias("status"))


def accept_relations(predicted: DataFrame, least: float = CONFIDENCE["relations"]) -> DataFrame:
    return predicted.filter((F.col("relation") != "NO_RELATION") & (F.col("confidence") >= least))


def known_relations(triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triplets of known relations under their normal names, rejected names with their counts)."""
    t = triplets.withColumn("relation", normalize_relation(F.col("relation")))
    good = F.col("relation").isin(*RELATION_TYPES)
    return t.filter(good & (F.trim("subject") != "") & (F.trim("object") != "")), t.filter(~good).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def co_mention_relations(entities: DataFrame, articles: DataFrame, verbs: dict[str, str] | None = None) -> DataFrame:
    """A rule provider of relations: two entities of one sentence with a known verb in it. Needs no model."""
    verbs = verbs or {"activat": "activates", "associated with": "associated_with", "bind": "binds", "cause": "causes", "inhibit": "inhibits", "treat": "treats"}
    s = articles.select("pmid", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("n", "sentence"))
    e = entities.join(s, "pmid").filter(F.contains(F.lower("sentence"), F.lower("text"))).select("pmid", "n", "sentence", "text", F.instr(F.lower("sentence"), F.lower("text")).alias("at"))
    relation = F.coalesce(*(F.when(F.contains(F.lower("sentence"), F.lit(v)), r) for v, r in verbs.items()))
    a, b = e.select("pmid", "n", "sentence", F.col("text").alias("subject"), F.col("at").alias("i")), e.select("pmid", "n", F.col("text").alias("object"), F.col("at").alias("j"))
    found = a.join(b, ["pmid", "n"]).filter("i < j and lower(subject) <> lower(object)").withColumn("relation", relation).filter("relation is not null")
    return found.select("pmid", "subject", "relation", "object").distinct()
