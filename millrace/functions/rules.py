"""Column builders for rules of topics, documents, training and judging: tables of thresholds, each one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let, tokens

# Domains of documents with their keywords, in order of preference.
DOMAINS = {
    "esg_sustainability": (
        "csrd", "sfdr", "taxonomy", "taksonomia", "esg", "sustainability", "non-financial", "raportowanie niefinansowe", "zrównoważony", "csddd", "due diligence",
        "łańcuch wartości", "emisje", "climate", "klimat", "biodiversity", "różnorodność biologiczna", "paris agreement", "porozumienie paryskie", "scope 1", "scope 2",
    ),
    "banking_compliance": (
        "crd", "crr", "dora", "mica", "basel", "capital requirement", "wymóg kapitałowy", "credit risk", "ryzyko kredytowe", "liquidity", "płynność", "leverage ratio",
        "wskaźnik dźwigni", "srep", "nsfr", "lcr", "tier 1", "tier 2", "pillar", "filar", "bazylea", "resolution", "bail-in",
    ),
    "data_privacy": (
        "gdpr", "rodo", "data protection", "ochrona danych", "personal data", "dane osobowe", "data subject", "osoba, której dane", "processor", "administrator", "controller",
        "consent", "zgoda", "breach", "naruszenie", "dpo", "ai act", "ustawa o ai", "data governance", "data act", "nis2", "cybersecurity",
    ),
    "tax_law": (
        "cit", "vat", "pit", "podatek", "tax", "mdr", "dac6", "beps", "pillar ii", "global minimum tax", "globalny podatek minimalny", "transfer pricing", "ceny transferowe",
        "permanent establishment", "zakład", "withholding tax", "podatek u źródła", "fatca", "crs",
    ),
    "labor_law": (
        "kodeks pracy", "labour", "employment", "zatrudnienie", "work time", "czas pracy", "leave", "urlop", "dismissal", "zwolnienie", "remuneration", "wynagrodzenie",
        "workplace", "work-life balance", "parental leave", "urlop rodzicielski", "posted worker", "delegowanie pracowników",
    ),
    "public_procurement": (
        "pzp", "zamówienie publiczne", "public procurement", "przetarg", "tender", "zamawiający", "wykonawca", "oferta", "siwz", "swz", "concession", "koncesja", "utility",
        "sektorowy", "national security", "bezpieczeństwo narodowe",
    ),
    "pharma_medical": (
        "mdr", "ivdr", "medical device", "wyroby medyczne", "gmp", "good manufacturing", "ema", "clinical trial", "badanie kliniczne", "marketing authorisation",
        "pozwolenie na dopuszczenie", "pharmacovigilance", "nadzór nad bezpieczeństwem", "hta", "health technology assessment",
    ),
    "accounting_ifrs": (
        "mssf", "ifrs", "ias", "fair value", "wartość godziwa", "impairment", "utrata wartości", "revenue recognition", "przychody", "lease", "leasing", "financial instruments",
        "instrumenty finansowe", "consolidation", "konsolidacja", "audit", "rewizja finansowa", "going concern",
    ),
    "construction_real_estate": (
        "prawo budowlane", "construction law", "pozwolenie na budowę", "building permit", "nieruchomość", "real estate", "deweloper", "warunki techniczne",
        "technical conditions", "architect", "urbanistyka", "mpzp", "study uwarunkowań",
    ),
}
DEFAULT_DOMAIN, LEAST_DOMAIN_SCORE = "general_legal", 0.003
# What a topic's sources must have: least number, least number of tiers S and A, and the kinds of which one is needed.
LEGISLATIVE = ("eurlex", "curia", "federalregister", "secedgar", "esma", "eba", "oecd", "wto", "wipo", "epo")
ECONOMIC = ("imf", "worldbank", "ecb", "bis", "eurostat", "owid", "irena", "undl", "hdx")
RESEARCH = ("arxiv", "openalex", "semanticscholar", "pubmed", "core", "ieee", "ssrn", "europepmc", "philpapers", "acm", "base", "chemrxiv", "engrxiv")
TOPIC_GATES = {
    "legal_regulatory": (3, 2, "min_1_legislative_source", LEGISLATIVE),
    "climate_finance": (4, 2, "min_1_policy_or_econ_source", LEGISLATIVE + ECONOMIC),
    "health_medtech": (4, 2, "min_1_research_source", RESEARCH),
    "ai_data_governance": (3, 2, "min_1_regulatory_or_research_source", LEGISLATIVE + RESEARCH),
    "capital_markets": (3, 2, "min_1_market_regulatory_source", ECONOMIC + LEGISLATIVE),
}
LEAST_QUALITY = 0.45
# What a judge's low dimension is called as a weakness.
WEAKNESSES = {"hallucination": "factual_accuracy", "grounding": "citations", "completeness": "depth", "language": "conciseness", "citation": "citations"}
# Phrases by which a prompt's perspective is known, in order.
PERSPECTIVE_HINTS = (("cfo", "cfo"), ("prawnik", "radcy prawnego"), ("audytor", "biegłego rewidenta"), ("cross_doc", "wielu aktów"))
# Keys of coverage weights and the perspectives they stand for.
PERSPECTIVE_KEYS = {
    "regulatory": "regulator", "financial": "cfo", "risk": "audytor", "esg_data": "analityk",
    "cross_reference": "akademik", "practical": "dziennikarz", "critical": "prawnik", "forward_looking": "inwestor",
}
# Bounds of the calibration that feedback adjusts.
QUALITY_BOUNDS, ADVERSARIAL_BOUNDS, TURN_BOUNDS, EMA_ALPHA = (0.60, 0.95), (0.05, 0.35), (1, 8), 0.3
# Trust of a source by its tier.
TRUST = {"S": 1.0, "A": 0.8, "B": 0.6, "C": 0.3}
# Models by the memory they need (GB).
MODELS = ((5.0, "Phi-4-Mini (3.8B)"), (7.0, "Llama-3.2-3B"), (12.0, "Llama-3.1-8B"), (48.0, "Llama-3.1-70B"))
# Log lines of a run.
PROGRESS = r"Progress:\s*(\d+)\s*chunks\s*\|\s*(\d+)\s*ready\s*\|\s*(\d+)\s*unresolvable\s*\|\s*(\d+)\s*records\s*\|\s*(\d+)\s*DPO"
RECORD, FOUND = r"✓ Record (\d+) written", r"Found (\d+) pending chunks"
# Phrases that announce from when a text applies, and the dates behind them.
VALID_FROM = r"(?i)(?:wchodzi w życie|applicable from|valid from|effective|od dnia)\s*:?\s*(\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}[./-]\d{2}[./-]\d{2})"
DATE_FORMATS = ("d.M.y", "d/M/y", "d-M-y", "y-M-d", "y.M.d")


def domain(text: Column) -> Column:
    """Struct of domain, score (keywords found by number of words) and confidence; a weak score means the default domain."""

    def judge(low: Column) -> Column:
        n = F.greatest(F.size(tokens(low)), F.lit(1))
        hits = [reduce(lambda a, b: a + b, [F.contains(low, F.lit(k)).cast("int") for k in words]) for words in DOMAINS.values()]
        ranked = F.array_max(F.array(*[F.struct(h.alias("hits"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (h, name) in enumerate(zip(hits, DOMAINS, strict=True))]))

        def named(best: Column) -> Column:
            score = best["hits"] / n
            weak = score < LEAST_DOMAIN_SCORE
            name = F.when(weak, DEFAULT_DOMAIN).otherwise(best["name"])
            confidence = F.when(weak, score).otherwise(F.round(F.least(score / (LEAST_DOMAIN_SCORE * 5), F.lit(1.0)), 2))
            return F.struct(name.alias("domain"), score.alias("score"), confidence.alias("confidence"))

        return let(ranked, named)

    return let(F.lower(F.coalesce(text, F.lit(""))), judge)


def valid_from(text: Column) -> Column:
    """The first date behind a phrase that announces it; null where there is none, or no such day."""
    raw = F.regexp_extract(text, VALID_FROM, 1)
    return F.coalesce(*[F.try_to_date(raw, f) for f in DATE_FORMATS])


def directive_year(name: Column, text: Column) -> Column:
    """A year of this century from the file's name, else from the first 500 characters."""
    year = lambda c: F.nullif(F.regexp_extract(c, r"(?<![\p{L}\p{N}_])(20\d{2})(?![\p{L}\p{N}_])", 1), F.lit(""))
    return F.coalesce(year(name), year(F.substring(text, 1, 500))).cast("int")


def parsed_date(raw: Column, formats) -> Column:
    """The timestamp by the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in formats])


def topic_gate(category: Column, n_sources: Column, high_tier: Column, kinds: Column, quality: Column) -> Column:
    """Reasons (an array) why a topic fails its category's gate; empty where it passes."""
    reason = lambda fails, name: F.when(fails, F.lit(name))
    own = F.lit(None).cast("array<string>")
    for name, (sources, high, missing, needed) in TOPIC_GATES.items():
        lacks = ~F.arrays_overlap(kinds, F.array(*map(F.lit, needed)))
        rules = F.array(reason(n_sources < sources, f"min_{sources}_sources"), reason(high_tier < high, f"min_{high}_high_tier_sources"), reason(F.coalesce(lacks, F.lit(True)), missing))
        own = F.coalesce(own, F.when(category == name, rules))
    other = F.array(reason(n_sources < 3, "min_3_sources"), reason(high_tier < 1, "min_1_high_tier_source"))
    return F.array_compact(F.concat(F.array(reason(quality < LEAST_QUALITY, "quality_score<0.45")), F.coalesce(own, other)))


def temporal_gap(models_after: Column, recency: Column) -> Column:
    return 0.6 * models_after / 8 + 0.4 * recency


def probe_scores(answers: tuple[Column, Column], distance: Column) -> tuple[Column, Column]:
    """Uncertainty (mean of two probes) and divergence (distance over 0.35), within 0 and 1."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return clamp((answers[0] + answers[1]) / 2), clamp(distance / 0.35)


def weaknesses(dimensions: dict[str, Column]) -> Column:
    """Names of dimensions below 0.7 (a missing one counts as 1), in the table's order; a name may repeat."""
    return F.array_compact(F.array(*[F.when(F.coalesce(dimensions[d], F.lit(1.0)) < 0.7, F.lit(name)) for d, name in WEAKNESSES.items()]))


def perspective(prompt: Column) -> Column:
    low = F.lower(prompt)
    return F.coalesce(*[F.when(F.contains(low, F.lit(hint)), F.lit(name)) for name, hint in PERSPECTIVE_HINTS], F.lit("unknown"))


def perspective_weight(name: Column, weights: dict[str, float]) -> Column:
    """The coverage weight of a perspective (1 where unknown): lower ones come first."""
    known = [F.when(name == p, F.lit(float(weights[key]))) for key, p in PERSPECTIVE_KEYS.items() if key in weights]
    return F.coalesce(*known, F.lit(1.0)) if known else F.lit(1.0)


def trust(tier: Column) -> Column:
    return F.coalesce(*[F.when(tier == t, F.lit(v)) for t, v in TRUST.items()], F.lit(TRUST["C"]))


def _bounded(x: Column, bounds: tuple[float, float]) -> Column:
    return F.greatest(F.lit(bounds[0]), F.least(x, F.lit(bounds[1])))


def adjusted(hallucination: Column, quality: Column, critiqued: Column, weak: Column, threshold: Column, adversarial: Column, turns: Column) -> Column:
    """Struct of the next threshold, adversarial ratio and turns after a cycle's report; ``weak`` is an array of weakness names."""
    ema = lambda old, new: EMA_ALPHA * new + (1 - EMA_ALPHA) * old
    has = lambda *names: F.arrays_overlap(F.transform(weak, F.lower), F.array(*map(F.lit, names)))
    up = lambda x, step: ema(x, F.least(x + step, F.lit(QUALITY_BOUNDS[1])))
    relaxed = ema(threshold, F.greatest(threshold - 0.01, F.lit(QUALITY_BOUNDS[0])))
    t = F.when(hallucination > 0.10, up(threshold, 0.04)).when(hallucination > 0.05, up(threshold, 0.02)).when((hallucination < 0.01) & (quality > 0.88), relaxed).otherwise(threshold)
    t = F.when(has("accuracy", "factual", "factual_accuracy", "citations"), up(t, 0.02)).otherwise(t)
    more, less = ema(adversarial, F.least(adversarial + 0.05, F.lit(ADVERSARIAL_BOUNDS[1]))), ema(adversarial, F.greatest(adversarial - 0.02, F.lit(ADVERSARIAL_BOUNDS[0])))
    a = F.when(critiqued == 0, adversarial).when(quality < 0.70, more).when((quality > 0.90) & (adversarial > 0.12), less).otherwise(adversarial)
    n = F.when(has("brevity", "verbosity", "conciseness"), F.greatest(turns - 1, F.lit(TURN_BOUNDS[0]))).when(has("depth", "completeness", "comprehensiveness"), F.least(turns + 1, F.lit(TURN_BOUNDS[1]))).otherwise(turns)
    return F.struct(F.round(_bounded(t, QUALITY_BOUNDS), 4).alias("threshold"), F.round(_bounded(a, ADVERSARIAL_BOUNDS), 4).alias("adversarial"), _bounded(n, TURN_BOUNDS).cast("int").alias("turns"))


# Perspectives of questions, by how much a weakness raises one's weight, and the greatest weight.
WEIGHED = ("regulatory", "financial", "risk", "esg_data", "cross_reference", "practical", "critical", "forward_looking")
RAISED, WEIGHTIEST = 0.3, 2.0


def perspective_weights(weak: Column) -> Column:
    """Map of each perspective's weight for the next cycle: every weakness whose name holds the perspective's, or lies in it, raises it."""
    matching = lambda p: F.size(F.filter(F.coalesce(weak, F.array().cast("array<string>")), lambda w: F.contains(w, F.lit(p)) | F.contains(F.lit(p), w)))
    entries = [x for p in WEIGHED for x in (F.lit(p), F.round(F.least(1.0 + RAISED * matching(p), F.lit(WEIGHTIEST)), 6))]
    return F.create_map(*entries)


def batch_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Prices are for a million tokens."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def training_plan(n: Column, model: Column, batch: int, accumulate: int) -> Column:
    """Struct of epochs, learning rate, warm-up, save and evaluation steps by the number of samples and the model's name."""
    epochs = F.when(n < 500, 5).when(n < 1000, 4).when(n < 3000, 3).when(n < 8000, 2).otherwise(1)
    low = F.lower(model)
    rate = F.when(F.contains(low, F.lit("70b")), 5e-5).when(F.contains(low, F.lit("8b")), 1e-4).otherwise(2e-4) * F.when(n > 5000, 0.5).otherwise(1.0)
    steps = F.greatest(F.floor(n / (batch * accumulate)), F.lit(1))
    warm = F.least(F.floor(steps * 0.1), F.lit(200))
    return F.struct(epochs.alias("epochs"), rate.alias("rate"), warm.alias("warmup"), F.greatest(F.floor(steps / 2), F.lit(10)).alias("save"), F.greatest(F.floor(steps / 4), F.lit(5)).alias("eval"))


def model_for(memory: Column) -> Column:
    """The largest model that fits with 2 GB to spare, else the smallest; without a card the hosted one."""
    fits = F.coalesce(*[F.when(memory - 2 >= need, F.lit(name)) for need, name in reversed(MODELS)], F.lit(MODELS[0][1]))
    return F.when(F.coalesce(memory, F.lit(0.0)) <= 0, "API fine-tune (no GPU)").otherwise(fits)


def log_line(line: Column, complete: str = "Run Complete") -> Column:
    """Struct of what a run's log line says: done, records, pairs, total and status; null where it says nothing of it."""
    at = lambda pattern, k: F.nullif(F.regexp_extract(line, pattern, k), F.lit("")).cast("int")
    progress = at(PROGRESS, 1)
    found = F.when(progress.isNull(), at(FOUND, 1))
    record = F.when(progress.isNull() & found.isNull(), at(RECORD, 1) + 1)
    done = progress.isNull() & found.isNull() & record.isNull() & F.contains(line, F.lit(complete))
    status = F.when(found.isNotNull(), "running").when(done, "done")
    return F.struct(progress.alias("done"), F.coalesce(at(PROGRESS, 4), record).alias("records"), at(PROGRESS, 5).alias("pairs"), found.alias("total"), status.alias("status"))
