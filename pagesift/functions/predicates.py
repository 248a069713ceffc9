"""Filters as boolean columns, and the small DataFrame operators built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scalars import col, hash_frac, issue_year, parse_money, strip

# What a document name must and must not contain to be fetched, and names to skip with a reason.
INCLUDE = r"(?i)(arch|floor ?plan|plans|drawing|dwg|cd set|construction doc|layout|elevation|interior|permit set|pricing set|issued for|bid set|\bA[-. ]?[0-9]{3})"
EXCLUDE = r"(?i)(\.msg|\.doc|\.jpg|\.jpeg|\.png|\.xls|\.zip|\.heic|struct|mep\b|mech|elec|plumb|civil|fire|sprink|survey|receipt|invoice|contract|license|letter|approval|extension|permit card|inspection|asbestos|riser|framing|elev_|elevator|hvac|energy|comcheck|certificate|backflow|swmp|foundation|shop drawing)"
SKIP = r"(?i)(struct|mep|mech|elec|plumb|civil|fire|survey|receipt|invoice|contract|license|letter|approval|extension)"
BLOCKED = r"(?i)(captcha|recaptcha|hcaptcha|verify\s+you\s+are\s+human|checking\s+your\s+browser|cloudflare|cf-chl|access\s+denied)"
TENANT = r"(?i)(tenant|build-?out|suite|interior)"
KEEP = ("floor_plan", "finish_plan", "finish_schedule", "demo_plan")
FINISH = ("finish_plan", "finish_schedule")
FLOORDEMO = ("floor_plan", "demo_plan")


def cost_between(c, low: float, high: float | None = None) -> Column:
    """``low <= c < high``; false for null."""
    inside = (col(c) >= low) if high is None else (col(c) >= low) & (col(c) < high)
    return F.coalesce(inside, F.lit(False))


def issue_from(c, year: int) -> Column:
    return F.coalesce(issue_year(c) >= year, F.lit(False))


def issue_before(c, year: int) -> Column:
    return F.coalesce(issue_year(c) < year, F.lit(False))


def issue_empty(c) -> Column:
    return F.trim(F.coalesce(col(c), F.lit(""))) == ""


def build_strata(
    kinds=("NEWC", "RNVS", "RNVN"), bands=(50_000, 250_000, 1_000_000, 10_000_000), pivot: int = 2022,
    kind="permitType", cost="estProjectCost", date="issueDate", text="description", tenant: str = TENANT,
) -> list[tuple[str, Column]]:
    """The twelve ordered strata (they overlap) as (label, condition), over raw text columns."""
    new, shell, tenant_kind = (F.coalesce(col(kind) == k, F.lit(False)) for k in kinds)
    low, mid, high, top = bands
    money = parse_money(col(cost).cast("string"))
    since, before = issue_from(date, pivot), issue_before(date, pivot)
    return [
        (f"01 {kinds[0]} top any era", new & cost_between(money, top)),
        (f"02 {kinds[0]} high recent", new & cost_between(money, high, top) & since),
        (f"03 {kinds[0]} high old", new & cost_between(money, high, top) & before),
        (f"04 {kinds[1]} high recent", shell & cost_between(money, high, top) & since),
        (f"05 {kinds[1]} high old", shell & cost_between(money, high, top) & before),
        (f"06 {kinds[1]} mid recent", shell & cost_between(money, mid, high) & since),
        (f"07 {kinds[2]} high recent", tenant_kind & cost_between(money, high, top) & since),
        (f"08 {kinds[2]} mid recent", tenant_kind & cost_between(money, mid, high) & since),
        (f"09 {kinds[2]} mid old", tenant_kind & cost_between(money, mid, high) & before),
        (f"10 {kinds[2]} low recent", tenant_kind & cost_between(money, low, mid) & since),
        ("11 no date", issue_empty(date)),
        (f"12 {kinds[2]} mid tenant", tenant_kind & cost_between(money, mid, high) & F.coalesce(col(text).rlike(tenant), F.lit(False))),
    ]


def stratum_flags(df: DataFrame, strata: list[tuple[str, Column]], out: str = "strata") -> DataFrame:
    """Add the array of labels of the strata that a row is in, in their order."""
    labels = F.array(*[F.when(cond, F.lit(name)) for name, cond in strata])
    return df.withColumn(out, F.filter(labels, lambda x: x.isNotNull()))


def screen_names(df: DataFrame, name: str = "name", include: str = INCLUDE, exclude: str = EXCLUDE) -> DataFrame:
    """Rows whose name matches ``include`` and not ``exclude``."""
    return df.where(col(name).rlike(include) & ~col(name).rlike(exclude))


def skip_reason(c, pattern: str = SKIP) -> Column:
    """The first word that makes a name one to skip, in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(col(c), pattern, 1)), F.lit(""))


def has_text(c) -> Column:
    """Whether anything but blanks is there; false for null."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def is_block_page(c, pattern: str = BLOCKED) -> Column:
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def with_flags(df: DataFrame, category: str = "category", **sets) -> DataFrame:
    """Boolean columns for membership of category sets: keep, finish and floordemo by default. Null is in none."""
    for name, members in (sets or {"keep": KEEP, "finish": FINISH, "floordemo": FLOORDEMO}).items():
        df = df.withColumn(name, F.coalesce(col(category).isin(*members), F.lit(False)))
    return df


def predict(df: DataFrame, thr: float, score: str = "score", out: str = "pred") -> DataFrame:
    return df.withColumn(out, F.coalesce(col(score) >= thr, F.lit(False)))


def settled(df: DataFrame, key: str, seq: str, status="status", ids="ids", pairs="pairs", ok=("ok", "not_found")) -> DataFrame:
    """Rows that need no further work: the first of each key among those with an ``ok`` status, without rows of
    status ``ok[0]`` that have ids but no pairs."""
    from ..operators.windows import first_per_key

    stale = (col(status) == ok[0]) & (F.coalesce(col(ids), F.lit("")) != "") & (F.coalesce(col(pairs), F.lit("")) == "")
    return first_per_key(df.where(col(status).isin(*ok) & ~stale), [key], seq)


def claim(df: DataFrame, status: str, done: DataFrame, key: str, order: str, column: str = "status") -> DataFrame:
    """Rows of one status that are not in ``done``, in order."""
    return df.where(col(column) == status).join(done.select(key).distinct(), key, "left_anti").orderBy(order)


def target_by_vocab(pages: DataFrame, pattern: str, text="text", group="doc_id") -> DataFrame:
    """Groups whose text mentions the vocabulary: hits and pages, most hits first."""
    return pages.groupBy(group).agg(F.count_if(F.coalesce(col(text).rlike(pattern), F.lit(False))).alias("hits"), F.count("*").alias("pages")).where("hits > 0").orderBy(F.desc("hits"), group)


def cap_pages(df: DataFrame, n: int = 150, index: str = "page_index") -> DataFrame:
    return df.where(col(index) < n)


def training_grade(labels: DataFrame, least: float = 0.8, confidence: str = "confidence") -> DataFrame:
    return labels.where(col(confidence) >= least)


def subset(df: DataFrame, ids: list, key: str) -> DataFrame:
    """The rows of a list of ids; an empty list means all."""
    return df.where(col(key).isin(*ids)) if ids else df


def review_queue(labels: DataFrame, thr: float = 0.8, audit: float = 0.1, seed: int = 42, id_: str = "page_id", confidence: str = "confidence", flag: str = "flag_reason") -> DataFrame:
    """Rows to review, one reason each: low confidence, flagged, or a seeded audit of the rest."""
    flagged = F.coalesce(col(flag), F.lit("")) != ""
    reason = F.when(F.coalesce(col(confidence) < thr, F.lit(True)), "low_confidence").when(flagged, "flagged").when(hash_frac(id_, seed) < audit, "audit")
    return labels.withColumn("reason", reason).where("reason IS NOT NULL")
