"""Data-quality checks as rows, component scores and weighted totals."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lectern.functions.values import renormalised_score, weighted_score
from lectern.operators.relational import orphans, present

#: Weights of the total score, and of the component scores.
TOTAL = {
    "schema_completeness": 0.10, "relational_integrity": 0.20, "studyprogram_quality": 0.20, "document_quality": 0.15, "parser_import_quality": 0.15,
    "final_program_course_quality": 0.15, "course_catalogue_quality": 0.05,
}
COMPONENTS = {
    "studyprogram_quality": {"completeness": 0.35, "valid_degree": 0.15, "valid_ects": 0.15, "known_faculty": 0.10, "with_documents": 0.15, "with_courses": 0.10},
    "document_quality": {"completeness": 0.30, "valid_types": 0.15, "parsed": 0.20, "programs_with_documents": 0.15, "unique_urls": 0.10, "no_duplicates": 0.10},
    "parser_import_quality": {"raw_text": 0.20, "source_doc": 0.20, "code": 0.25, "valid_code": 0.20, "title": 0.10, "inferred_type": 0.05},
    "final_program_course_quality": {"valid_types": 0.25, "course_name": 0.15, "programs_with_links": 0.40, "no_duplicates": 0.20},
    "course_catalogue_quality": {"name": 0.35, "plausible_ects": 0.25, "with_offering": 0.25, "with_teacher": 0.15},
    "document_parsing": {
        "unique_doc_parse_coverage": 0.25, "metadata_block_coverage": 0.15, "doc_key_consistency": 0.10, "core_metadata_completeness": 0.15, "usable_text_rate": 0.15,
        "heading_detection_rate": 0.10, "ects_signal_rate": 0.05, "deduplicated_doc_key_rate": 0.05,
    },
    "document_download": {"download_success_all_refs": 0.30, "program_doc_availability": 0.25, "actionable_source_type": 0.15, "deduplication_by_doc_key": 0.10, "metadata_completeness": 0.20},
    "json_integrity": {"program_field_completeness": 0.30, "academic_core_completeness": 0.20, "curriculum_url_coverage": 0.15, "document_coverage": 0.25, "deduplication": 0.10},
}
#: A study programme table with duplicates loses a fifth of its score.
DUPLICATE_PENALTY = 0.8

CHECK = "name string, category string, severity string, passed boolean, value double, total long"


@dataclass(frozen=True)
class Rule:
    """A named condition that a table's rows should meet; the check passes if the share of good rows reaches ``least``."""

    name: str
    category: str
    table: str
    good: Column
    severity: str = "error"
    least: float = 1.0


def row_checks(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """Checks of all rules, one pass over every table; an empty table passes with a null value."""
    out = []
    for name, df in tables.items():
        own = [r for r in rules if r.table == name]
        if own:
            one = df.agg(F.count("*").alias("total"), *[F.count(F.when(r.good, 1)).alias(f"g{i}") for i, r in enumerate(own)])
            rows = [
                F.struct(F.lit(r.name).alias("name"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"),
                         F.coalesce(F.try_divide(f"g{i}", "total") >= r.least, F.lit(True)).alias("passed"), F.try_divide(f"g{i}", "total").alias("value"), F.col("total").alias("total"))
                for i, r in enumerate(own)
            ]
            out.append(one.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, out)


def foreign_key_checks(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]], views: dict[str, tuple[str, dict[str, str]]] | None = None) -> DataFrame:
    """(name, orphans, total, rate) of every (child, column, parent, column); null keys aren't orphans.

    All keys are checked in one pass: every table is read once and gives its values, each with bits for the keys that it belongs to or as a parent's;
    values meet by one shuffle, counted before they move, so that a value of many rows is one row a task. A value has a counter for each key of its
    own parent only, and whole numbers stay numbers. ``views``: tables with one row for each row of another table, as that table and SQL of their columns
    over its own; they are read along with it.
    """
    views = views or {}
    spaces = sorted({(p, c) for _, _, p, c in keys})
    children = [[k for k, key in enumerate(keys) if key[2:] == space] for space in spaces]
    number = lambda t, c: isinstance(tables[t].schema[c].dataType, IntegralType)
    whole = [number(*space) and all(number(*keys[k][:2]) for k in ks) for space, ks in zip(spaces, children)]
    roles: dict[str, dict[tuple[int, str], int]] = {}

    def add(t: str, c: str, space: int, bit: int) -> None:
        source, columns = views.get(t, (t, {}))
        own = roles.setdefault(source, {})
        place = space, columns.get(c, c)
        own[place] = own.get(place, 0) | 1 << bit

    for i, (space, ks) in enumerate(zip(spaces, children)):
        add(*space, i, 0)
        for n, k in enumerate(ks):
            add(*keys[k][:2], i, n + 1)

    def role(space: int, column: str, bits: int) -> Column:
        v, none = F.expr(column), F.lit(None)
        number, text = (v, none) if whole[space] else (none, v)
        return F.struct(F.lit(space).alias("space"), number.cast("long").alias("number"), text.cast("string").alias("text"), F.lit(bits).cast("long").alias("bits"))

    values = reduce(DataFrame.unionByName, [tables[t].select(F.explode(F.array(*[role(*place, bits) for place, bits in r.items()])).alias("r")).select("r.*") for t, r in roles.items()])
    has = lambda n: F.col("bits").bitwiseAND(1 << n) != 0
    slots = range(1, 1 + max(map(len, children)))
    met = values.where("number is not null or text is not null").groupBy("space", "number", "text").agg(F.max(has(0)).alias("there"), *[F.count_if(has(n)).alias(f"n{n}") for n in slots])
    by_space = met.groupBy("space").agg(*[x for n in slots for x in (F.sum(f"n{n}").alias(f"t{n}"), F.sum(F.when(~F.col("there"), F.col(f"n{n}"))).alias(f"o{n}"))])
    of = [(k, i, n + 1) for i, ks in enumerate(children) for n, k in enumerate(ks)]
    sums = by_space.agg(*[F.coalesce(F.sum(F.when(F.col("space") == i, F.col(f"{x}{n}"))), F.lit(0)).alias(f"{x}{k}") for k, i, n in of for x in "to"])
    rows = [F.struct(F.lit(f"{child}.{column}").alias("name"), F.col(f"o{k}").alias("orphans"), F.col(f"t{k}").alias("total"), F.try_divide(f"o{k}", f"t{k}").alias("rate")) for k, (child, column, _, _) in enumerate(keys)]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def schema_checks(tables: dict[str, DataFrame], expected: dict[str, list[str]]) -> list[tuple[str, bool]]:
    """(table or table.column, exists) by the catalog alone."""
    out = []
    for t, columns in expected.items():
        out.append((t, t in tables))
        out += [(f"{t}.{c}", t in tables and c in tables[t].columns) for c in columns]
    return out


def summary(checks: DataFrame) -> DataFrame:
    """(grouping, value, total, passed, failed) of all checks, by category and by severity."""
    counts = [F.count("*").alias("total"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.when(~F.col("passed"), 1)).alias("failed")]
    all_ = checks.agg(*counts).select(F.lit("all").alias("grouping"), F.lit("all").alias("value"), "total", "passed", "failed")
    by = [checks.groupBy(F.col(c).alias("value")).agg(*counts).select(F.lit(c).alias("grouping"), "value", "total", "passed", "failed") for c in ("category", "severity")]
    return reduce(DataFrame.unionByName, [all_, *by])


def score(spark: SparkSession, values: dict[str, float | None], weights: dict[str, float], renormalise: bool = False, penalty: float = 1.0) -> float | None:
    """Weighted sum of clamped values, to six digits; values that are missing count as 0, or not at all if ``renormalise``."""
    parts = {k: (F.lit(values.get(k)).cast("double"), w) for k, w in weights.items()}
    got = spark.range(1).select(F.round((renormalised_score(parts) if renormalise else weighted_score(parts)) * penalty, 6)).first()[0]
    return None if got is None else float(got)


def prefer(metrics: DataFrame, priority: list[str]) -> DataFrame:
    """(metric, value, source): of every metric the non-null value of the source that stands first in ``priority``."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source"))
    known = metrics.where("value is not null").withColumn("_o", F.when(order > 0, order).otherwise(len(priority) + 1))
    return known.groupBy("metric").agg(F.min_by(F.struct("value", "source"), F.struct("_o", "source")).alias("b")).select("metric", "b.value", "b.source")


def credit_consistency(stated: Column, found: Column) -> Column:
    """ok, mismatch, or ambiguous where credits aren't stated or none are found."""
    return F.when(stated.isNull() | (F.coalesce(F.size(found), F.lit(0)) <= 0), "ambiguous").when(F.array_contains(found, stated), "ok").otherwise("mismatch")


def with_manual_review(compared: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """``compared`` with statuses replaced by those of hand-made reviews."""
    r = reviews.select(key, F.col("status").alias("_status")).dropDuplicates([key])
    return compared.join(r, key, "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def reason_counts(matches: DataFrame, reasons: str = "reasons") -> DataFrame:
    """(reason, n): how often every reason of a list column occurs."""
    return matches.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def score_summary(matches: DataFrame) -> DataFrame:
    """One row: number, least, mean and largest score."""
    return matches.agg(F.count("*").alias("n"), F.min("score").alias("least"), F.avg("score").alias("mean"), F.max("score").alias("most"))


def evaluation_summary(rows: DataFrame, measures: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, median and count of every measure, in all or by groups; nulls don't count."""
    aggs = [a for m in measures for a in (F.avg(m).alias(f"{m}_mean"), F.median(m).alias(f"{m}_median"), F.count(m).alias(f"{m}_n"))]
    return rows.groupBy(*(by or [])).agg(*aggs)


def coverage(expected: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """One row: expected, parsed, missing and unexpected keys, and the share of expected ones that are parsed."""
    e, p = expected.select(key).distinct().withColumn("_e", F.lit(1)), parsed.select(key).distinct().withColumn("_p", F.lit(1))
    x = e.join(p, key, "full")
    return x.agg(F.count("_e").alias("expected"), F.count("_p").alias("parsed"), F.count(F.when(F.col("_p").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_e").isNull(), 1)).alias("unexpected"), F.try_divide(F.count(F.when(F.col("_e").isNotNull() & F.col("_p").isNotNull(), 1)), F.count("_e")).alias("coverage"))


#: What counts as valid, and the fields whose completeness counts.
LEVELS, DOC_TYPES, COURSE_TYPES = ("Bachelor", "Master", "Doctorate"), ("study_plan", "regulation", "brochure", "other"), ("Mandatory", "Elective")
PARSED = ("ok", "parsed", "downloaded", "already_present", "success")
UNKNOWN_FACULTY = 100


def _repeated(df: DataFrame, keys: list[Column]) -> DataFrame:
    """One row, ``again``: whether any key occurs twice."""
    return df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n")).agg(F.coalesce(F.max(F.col("n") > 1), F.lit(False)).alias("again"))


def _rows(one: DataFrame, component: str, measures: dict[str, Column], factor: Column | None = None) -> DataFrame:
    weights = COMPONENTS[component]
    entries = [F.struct(F.lit(m).alias("measure"), c.cast("double").alias("value"), F.lit(weights[m]).alias("weight")) for m, c in measures.items()]
    return one.select(F.explode(F.array(*entries)).alias("r"), (F.lit(1.0) if factor is None else factor).alias("factor")).select(F.lit(component).alias("component"), "r.*", "factor")


def component_measures(t: dict[str, DataFrame]) -> DataFrame:
    """(component, measure, value, weight, factor) of the catalogue's tables, one pass over each; shares of nothing are null.

    ``factor`` lowers a component as a whole: a programme table with repeated (name, level, credits) loses a fifth.
    """
    n = lambda c: F.count(F.when(c, 1))
    share = lambda a, b: F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b))
    mean = lambda *cs: sum(cs[1:], cs[0]) / len(cs)
    codes = lambda name: t[name].select("code").distinct()
    p, d, s, c, course = (t[k] for k in ("studyprogram", "programdocument", "programcoursestaging", "consist_of", "course"))
    with_docs, with_courses = (x.select("program_id").where("program_id is not null").distinct() for x in (d, c))
    marked = p.join(with_docs.withColumn("_d", F.lit(1)), "program_id", "left").join(with_courses.withColumn("_c", F.lit(1)), "program_id", "left")
    filled = {k: present(p, k) for k in ("name", "degree_level", "total_ects", "faculty_id")}
    programmes = marked.agg(
        F.count("*").alias("total"), *[n(v).alias(f"f_{k}") for k, v in filled.items()], n(~F.col("degree_level").isin(*LEVELS)).alias("bad_level"), n(F.coalesce(F.col("total_ects").between(0.000001, 300), F.lit(False))).alias("good_ects"),
        n(F.col("faculty_id") == UNKNOWN_FACULTY).alias("unknown"), F.count("_d").alias("docs"), F.count("_c").alias("courses"),
    ).join(_repeated(p, [F.lower("name"), F.col("degree_level"), F.col("total_ects")]), F.lit(True))
    out = [_rows(programmes, "studyprogram_quality", {
        "completeness": mean(*[share(f"f_{k}", "total") for k in filled]), "valid_degree": share(F.col("total") - F.col("bad_level"), "total"), "valid_ects": share("good_ects", "total"),
        "known_faculty": share(F.col("total") - F.col("unknown"), "total"), "with_documents": share("docs", "total"), "with_courses": share("courses", "total"),
    }, F.when(F.col("again"), DUPLICATE_PENALTY).otherwise(1.0))]
    filled = {k: present(d, k) for k in ("program_id", "url", "doc_type")}
    parsed = F.lower("parse_status").isin(*PARSED) | F.col("parse_status").isNull() if "parse_status" in d.columns else F.lit(True)
    documents = d.agg(
        F.count("*").alias("total"), *[n(v).alias(f"f_{k}") for k, v in filled.items()], n(F.col("doc_type").isin(*DOC_TYPES)).alias("typed"), n(parsed).alias("parsed"), F.countDistinct("program_id").alias("owners"),
        F.countDistinct(F.when(filled["url"], F.col("url"))).alias("urls"),
    ).join(p.agg(F.count("*").alias("programmes")), F.lit(True)).join(_repeated(d, [F.col("program_id"), F.col("url"), F.col("doc_type")]), F.lit(True))
    once = F.when(F.col("again"), 0.0).otherwise(1.0)
    out.append(_rows(documents, "document_quality", {
        "completeness": mean(*[share(f"f_{k}", "total") for k in filled]), "valid_types": share("typed", "total"), "parsed": share("parsed", "total"), "programs_with_documents": share("owners", "programmes"),
        "unique_urls": share("urls", "total"), "no_duplicates": once,
    }))
    coded = s.withColumn("_code", F.nullif(F.trim("extracted_code"), F.lit(""))).join(course.select(F.col("code").alias("_code"), F.lit(1).alias("_known")).distinct(), "_code", "left")
    staged = coded.agg(F.count("*").alias("total"), *[n(present(s, k)).alias(k) for k in ("raw_text", "source_doc_id", "extracted_title", "inferred_type")], F.count("_code").alias("coded"), F.count("_known").alias("known"))
    out.append(_rows(staged, "parser_import_quality", {
        "raw_text": share("raw_text", "total"), "source_doc": share("source_doc_id", "total"), "code": share("coded", "total"), "valid_code": share("known", "coded"), "title": share("extracted_title", "total"), "inferred_type": share("inferred_type", "total"),
    }))
    links = c.agg(F.count("*").alias("total"), n(F.col("course_type").isin(*COURSE_TYPES)).alias("typed"), n(present(c, "course_name")).alias("named"), F.countDistinct("program_id").alias("owners"))
    links = links.join(p.agg(F.count("*").alias("programmes")), F.lit(True)).join(_repeated(c, [F.col("program_id"), F.col("code")]), F.lit(True))
    out.append(_rows(links, "final_program_course_quality", {"valid_types": share("typed", "total"), "course_name": share("named", "total"), "programs_with_links": share("owners", "programmes"), "no_duplicates": once}))
    taught = course.join(codes("courseoffering").withColumn("_o", F.lit(1)), "code", "left").join(codes("teaches").withColumn("_t", F.lit(1)), "code", "left")
    catalogue = taught.agg(F.count("*").alias("total"), n(present(course, "name")).alias("named"), n(F.col("ects").between(0, 60)).alias("plausible"), F.count("_o").alias("offered"), F.count("_t").alias("taught"))
    out.append(_rows(catalogue, "course_catalogue_quality", {"name": share("named", "total"), "plausible_ects": share("plausible", "total"), "with_offering": share("offered", "total"), "with_teacher": share("taught", "total")}))
    return reduce(DataFrame.unionByName, out)


def component_scores(measures: DataFrame) -> DataFrame:
    """(component, score): weighted sums of the measures, a missing one as 0, between 0 and 1."""
    clamped = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    value = F.coalesce(F.col("value"), F.lit(0.0)) * F.col("weight")
    return measures.groupBy("component").agg(clamped(F.sum(value) * F.min("factor")).alias("score"))


#: Match types that count as matched.
MATCHED = ("matched", "matched_by_doc", "matched_by_id", "fuzzy", "exact")


def stage_summary(records: DataFrame) -> DataFrame:
    """One row of each stage with its measures: records, keys, addresses, documents, shared documents, matches and their rates.

    ``records``: stage, key (of a programme), urls (list), curriculum_url, match_type.
    """
    urls = F.coalesce("urls", F.array().cast("array<string>"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    n = lambda c: F.count(F.when(c, 1))
    one = records.groupBy("stage").agg(
        F.count("*").alias("records"), F.countDistinct("key").alias("keys"), n(F.length(F.trim("curriculum_url")) > 0).alias("with_curriculum_url"), n(F.size(urls) > 0).alias("with_documents"), F.sum(F.size(urls)).alias("document_refs"),
        n(F.col("match_type").isin(*MATCHED)).alias("matched"), n(F.col("match_type") == "unmatched").alias("unmatched"),
    )
    per_url = records.select("stage", "key", F.explode(urls).alias("url")).groupBy("stage", "url").agg(F.countDistinct("key").alias("owners"))
    shared = per_url.groupBy("stage").agg(F.count("*").alias("unique_urls"), n(F.col("owners") > 1).alias("shared_urls"), n(F.col("owners") > 3).alias("suspicious_urls"))
    x = one.join(shared, "stage", "left").na.fill(0, ["unique_urls", "shared_urls", "suspicious_urls"])
    c = F.col
    return x.withColumns({
        "duplicate_records": c("records") - c("keys"), "duplicate_rate": rate(c("records") - c("keys"), c("records")), "curriculum_url_coverage": rate(c("with_curriculum_url"), c("records")), "document_coverage": rate(c("with_documents"), c("records")),
        "duplicate_refs": c("document_refs") - c("unique_urls"), "duplicate_ref_rate": rate(c("document_refs") - c("unique_urls"), c("document_refs")), "refs_per_record": rate(c("document_refs"), c("records")),
        "match_rate": F.round(F.try_divide(c("matched"), c("matched") + c("unmatched")), 6),
    })
