"""Entities, their co-occurrence and lookups as plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let


def entities(docs: DataFrame, key: str, body: str, pattern: str = "[A-Z][a-z]{6,}") -> DataFrame:
    """name, n_docs, first_doc and a stable id; every document counts once for a name."""
    named = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(0)))).alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("n_docs"), F.min(key).alias("first_doc")).withColumn("entity_id", F.substring(F.sha1(F.lower("name")), 1, 12))


def co_occurrence(sentences: DataFrame, body: str, pattern: str) -> DataFrame:
    """source < target and weight: names that stand in one sentence."""
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(0))))
    later = lambda found, i: F.slice(found, i + 2, F.greatest(F.size(found) - i - 1, F.lit(0)))
    pair = lambda x: lambda y: F.struct(x.alias("source"), y.alias("target"))
    pairs = let(names, lambda found: F.flatten(F.transform(found, lambda x, i: F.transform(later(found, i), pair(x)))))
    return sentences.select(F.explode(pairs).alias("p")).groupBy(F.col("p.source").alias("source"), F.col("p.target").alias("target")).agg(F.count("*").alias("weight"))


def neighbours(edges: DataFrame, name: str) -> DataFrame:
    """Names on the other end of an entity's edges, in both directions."""
    out = edges.where(F.col("source") == name).select(F.col("target").alias("name"), "weight")
    return out.unionByName(edges.where(F.col("target") == name).select(F.col("source").alias("name"), "weight")).groupBy("name").agg(F.sum("weight").alias("weight"))


def lookups(names: DataFrame, edges: DataFrame, nodes: DataFrame, hub: int = 10_000, salts: int = 64) -> DataFrame:
    """name, kind, direction, other, relation, confidence of every entity asked for (names: name), by any spelling of it, in one pass.

    ``edges`` are (source, target, relation, confidence), of which the greatest confidence of each stands; ``nodes`` are (name, kind).  An
    entity with more than ``hub`` edges is spread over ``salts`` parts.  A name that no node has gives nothing; one without edges
    gives one row with a null direction.
    """
    merged = edges.groupBy("source", "target", "relation").agg(F.max("confidence").alias("confidence"))
    both = merged.select(F.col("source").alias("name"), F.lit("outgoing").alias("direction"), F.col("target").alias("other"), "relation", "confidence")
    both = both.unionByName(merged.select(F.col("target").alias("name"), F.lit("incoming").alias("direction"), F.col("source").alias("other"), "relation", "confidence"))
    hubs = both.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("name", F.lit(salts).alias("parts"))
    known = nodes.groupBy("name").agg(F.min("kind").alias("kind"))
    asked = names.select(canonical(F.trim("name"), ALIASES).alias("name")).distinct().join(known, "name").join(hubs, "name", "left")
    asked = asked.select("name", "kind", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    spread = both.join(hubs, "name", "left").withColumn("salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("other", "relation"), F.col("parts"))).cast("int"))
    found = asked.join(spread.drop("parts"), ["name", "salt"], "left").drop("salt")
    lonely = found.groupBy("name").agg(F.count("direction").alias("n")).where("n = 0").select("name")
    rows = found.where("direction IS NOT NULL")
    return rows.unionByName(lonely.join(known, "name").select("name", "kind", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("direction", "other", "relation", "confidence")]))


def related(found: DataFrame, kind: str = "LAW") -> DataFrame:
    """name, other, relation, direction of the entities of one kind that a lookup found."""
    return found.where((F.col("kind") == kind) & F.col("other").isNotNull()).select("name", "other", "relation", "direction").distinct()


def summary(named: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """what, name, n: numbers of entities, relations and documents, and of each kind of entity and of relation."""
    kinds = named.select("name", "kind").distinct()
    merged = edges.select("source", "target", "relation").distinct()
    parts = [
        kinds.agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), F.lit("").alias("name"), "n"),
        merged.agg(F.count("*").alias("n")).select(F.lit("relations"), F.lit(""), "n"),
        named.agg(F.count_distinct(key).alias("n")).select(F.lit("documents"), F.lit(""), "n"),
        kinds.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("entity kind"), "kind", "n"),
        merged.groupBy("relation").agg(F.count("*").alias("n")).select(F.lit("relation kind"), "relation", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# Names of regulations, and concepts that count as entities.
REGULATION = (
    r"(?i)(?<![\p{L}\p{N}_])(CSRD|SFDR|TCFD|GRI|SASB|ESRS|EU\s+Taxonomy|NFRD|CSDDD|Pillar\s+III|TNFD|CDP|UNGC|SDG|Article\s+\d+|Directive\s+\d+/\d+/EC"
    r"|Regulation\s+\([A-Z]+\)\s+\d+/\d+)(?![\p{L}\p{N}_])"
)
CONCEPTS = (
    "double materiality", "Scope 1", "Scope 2", "Scope 3", "net zero", "carbon neutral", "just transition", "taxonomy alignment", "sustainable finance", "green bond", "social bond",
    "principal adverse impacts", "PAI", "do no significant harm", "DNSH", "minimum social safeguards", "transition plan", "climate risk", "physical risk", "transition risk", "stranded asset",
)
# Surface names of entities and what they are called.
ALIASES = {
    "corporate sustainability reporting directive": "CSRD", "csrd": "CSRD", "sustainable finance disclosure regulation": "SFDR", "sfdr": "SFDR",
    "corporate sustainability due diligence directive": "CSDDD", "cs3d": "CSDDD", "csddd": "CSDDD", "taxonomy regulation": "EU Taxonomy", "eu taxonomy regulation": "EU Taxonomy",
    "taxonomy": "EU Taxonomy", "non-financial reporting directive": "NFRD", "nfrd": "NFRD", "task force on climate-related financial disclosures": "TCFD", "tcfd": "TCFD",
    "global reporting initiative": "GRI", "gri": "GRI", "sustainability accounting standards board": "SASB", "sasb": "SASB", "european sustainability reporting standards": "ESRS", "esrs": "ESRS",
    "taskforce on nature-related financial disclosures": "TNFD", "tnfd": "TNFD", "carbon disclosure project": "CDP", "cdp": "CDP", "sustainable development goals": "SDG", "sdg": "SDG",
    "un global compact": "UNGC", "united nations global compact": "UNGC", "ungc": "UNGC", "eu ai act": "EU AI Act", "artificial intelligence act": "EU AI Act",
    "markets in financial instruments directive": "MiFID II", "mifid ii": "MiFID II", "mifid": "MiFID II", "solvency ii": "Solvency II",
}
# Verbs that make a relation of what follows within 80 characters, and its confidence.
RELATIONS = (
    ("AMENDS", r"(?i)\bamends?\b.{0,80}", 0.85), ("REQUIRES", r"(?i)\brequires?\b.{0,80}", 0.80), ("DEFINES", r"(?i)\bdefines?\b.{0,80}", 0.90),
    ("REFERENCES", r"(?i)\b(?:refers?\s+to|pursuant\s+to|under|within\s+the\s+meaning\s+of)\b.{0,80}", 0.75),
)


def mentions(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, name, kind, snippet): each document's regulations (LAW) and concepts once, by their canonical names, with 100 characters around the
    first place (200 at most)."""
    text = F.col(body)
    laws = F.transform(F.regexp_extract_all(text, F.lit(REGULATION), F.lit(1)), lambda m: F.struct(m.alias("said"), F.lit("LAW").alias("kind")))
    low = F.lower(text)
    concepts = F.filter(F.array(*[F.struct(F.lit(c).alias("said"), F.lit("CONCEPT").alias("kind")) for c in CONCEPTS]), lambda c: F.contains(low, F.lower(c["said"])))
    found = docs.select(key, text.alias("body"), F.posexplode(F.concat(laws, concepts)).alias("order", "m"))
    named = found.select(key, canonical(F.trim("m.said"), ALIASES).alias("name"), "m.kind", "order", F.col("m.said").alias("said"), "body")
    first = named.groupBy(key, F.upper("name").alias("upper"), "kind").agg(F.min_by(F.struct("name", "said", "body"), "order").alias("f"))
    at = F.instr(F.lower(F.col("f.body")), F.lower(F.col("f.said")))
    start = F.greatest(at - 100, F.lit(1))
    around = F.substring(F.col("f.body"), start, at - start + F.length("f.said") + 100)
    return first.select(key, "f.name", "kind", F.substring(F.trim(F.replace(around, F.lit("\n"), F.lit(" "))), 1, 200).alias("snippet"))


def relations(docs: DataFrame, key: str, body: str, named: DataFrame) -> DataFrame:
    """(key, source, target, relation, confidence): names of a document that stand in one sentence, and in what follows a relation's verb.

    ``named`` has key, name and kind.  Pairs are those of one sentence or window, by name.
    """
    names = named.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("name", "kind"))).alias("names"))  # a document's own
    rows = docs.select(key, F.col(body).alias("body")).join(names, key)
    said = lambda array, relation, confidence: F.transform(array, lambda s: F.struct(s.alias("said"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence")))
    sentence = said(F.split("body", r"(?<=[.!?])\s+"), "CO_OCCURS", 0.7)
    windows = [said(F.regexp_extract_all("body", F.lit(pattern), F.lit(0)), relation, confidence) for relation, pattern, confidence in RELATIONS]
    rows = rows.select(key, "names", F.explode(F.concat(sentence, *windows)).alias("w"))
    rows = rows.select(key, "w.relation", "w.confidence", F.filter("names", lambda n: F.contains(F.lower(F.col("w.said")), F.lower(n["name"]))).alias("here")).where(F.size("here") > 1)
    pairs = F.flatten(F.transform("here", lambda a, i: F.transform(F.slice("here", i + 2, F.size("here")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = rows.select(key, "relation", "confidence", F.explode(pairs).alias("p"))
    kinds = (F.col("p.a.kind"), F.col("p.b.kind"))
    typed = F.when((kinds[0] == "LAW") & (kinds[1] == "ORG"), "REGULATES").when((kinds[0] == "ORG") & (kinds[1] == "LAW"), "SUBJECT_TO").otherwise("CO_OCCURS")
    relation = F.when(F.col("relation") == "CO_OCCURS", typed).otherwise(F.col("relation"))
    return rows.select(key, F.col("p.a.name").alias("source"), F.col("p.b.name").alias("target"), relation.alias("relation"), "confidence")


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge for each source, target and relation, with how often it was found and its greatest confidence."""
    return edges.groupBy("source", "target", "relation").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def shared_entities(named: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Entities of at least so many documents, with their number: links between documents without their pairs."""
    return named.groupBy("name", "kind").agg(F.count_distinct(key).alias("n_docs")).where(F.col("n_docs") >= least)


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    """Alias, else names of up to six letters and hyphens in capitals, else as it is."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), F.lower(name)) if aliases else F.lit(None)
    return F.coalesce(known, F.when(name.rlike(r"^(?=.*\p{L})[\p{L}-]{1,6}$"), F.upper(name)), name)


def negated(text: Column, words) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), r"\s+"), F.array(*map(F.lit, words)))
