"""Loads: upserts, surrogate keys, quarantine, staging to final, flattening."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators.relational import latest_per_key
from lectern.sources.store import StoredTable
from lectern.storage import persist_shared


def _split_null_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(full), df.where(~full)


def upsert_last(df: DataFrame, keys: list[str], seq: str, nulls_merge: bool = True) -> DataFrame:
    """The row of the highest ``seq`` of every key. Without ``nulls_merge`` a key with a null never merges, as in SQL unique keys."""
    full, loose = (df, None) if nulls_merge else _split_null_keys(df, keys)
    others = [c for c in df.columns if c not in keys]
    out = full.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(seq)).alias("r")).select(*keys, "r.*").select(*df.columns)
    return out if loose is None else out.unionByName(loose)


def upsert_keep(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Every column's last value, by ``seq``, that isn't null."""
    others = [c for c in df.columns if c not in (*keys, seq)]
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in others], F.max(seq).alias(seq)).select(*df.columns)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """``existing`` and the first new row of every key it lacks; keys with a null are always new."""
    full, loose = _split_null_keys(new, keys)
    fresh = latest_per_key(full, keys, [F.asc(seq)]).join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns)).unionByName(loose.select(*existing.columns))


def surrogate_keys(values: DataFrame, column: str, name: str, existing: DataFrame | None = None) -> DataFrame:
    """(value, key): numbers from 1 (or after the largest one of ``existing``) in the order of the values; nulls get none.

    Values are sorted by ranges, written to the shared folder, and numbered by their place in the range and the sizes of
    the ranges before it: no task sees all values, whatever they look like. The driver sees a size for each range.
    """
    fresh = values.where(F.col(column).isNotNull()).select(column).distinct()
    base = 0
    if existing is not None:
        fresh = fresh.join(existing.select(column), column, "left_anti")
        base = existing.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
    row = F.monotonically_increasing_id()
    ranged = fresh.repartitionByRange(column).sortWithinPartitions(column).withColumns({"_part": F.shiftright(row, 33), "_row": row.bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = persist_shared(ranged, "ranges")
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, so_far = [], base
    for part in sorted(sizes):
        starts, so_far = [*starts, (part, so_far)], so_far + sizes[part]
    begins = values.sparkSession.createDataFrame(starts, "_part long, _start long")  # a row for each range
    out = ranged.join(F.broadcast(begins), "_part").select(column, (F.col("_start") + F.col("_row") + 1).cast("long").alias(name))
    return out if existing is None else existing.select(column, name).unionByName(out)


def update_changed(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``current`` with the columns of ``changes`` where they differ, and ``changed`` telling so."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_has"))
    both = current.join(new, key, "left")
    differs = F.coalesce("_has", F.lit(False)) & ~reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in columns])
    out = both.withColumn("changed", differs)
    return out.withColumns({c: F.when(F.col("changed"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).drop("_has", *[f"_new_{c}" for c in columns])


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): a row is rejected with the names of all rules it breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    marked = df.withColumn("reasons", broken)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def staging_to_final(staging: DataFrame, courses: DataFrame) -> DataFrame:
    """(program_id, code, course_name, course_type, description) of staged course references.

    References of a programme and code keep their latest row (by page, source and staging number, nulls last), meet
    the catalogue by code or alternative code, and take the course type that was staged (``inferred_type``, if there is
    one) or else the one that their words say (Mandatory if none do).
    """
    staged = F.trim("inferred_type") if "inferred_type" in staging.columns else F.lit(None)
    kind = F.when(staged.isin("Mandatory", "Elective"), staged).otherwise(T.course_type(F.col("section"), F.col("extracted_title"), F.col("raw_text")))
    refs = staging.where((F.col("reference_type") == "course") & (F.trim("extracted_code") != "")).withColumn("ref", F.trim("extracted_code"))
    refs = refs.withColumn("course_type", kind).drop("raw_text", "inferred_type")  # so that whole texts don't move
    order = [F.desc_nulls_last("fetched_at"), F.desc_nulls_last("page_no"), F.desc_nulls_last("source_doc_id"), F.desc_nulls_last("staging_id")]
    latest = latest_per_key(refs, ["program_id", "ref"], order)
    known = courses.select(F.col("code").alias("course_code"), "alternative_code", F.col("name").alias("canonical_name"))
    # what both codes meet is one row for the last step, so that the pairs need no sorting out before
    met = latest.join(known, F.col("ref") == F.col("course_code")).unionByName(latest.join(known, F.col("ref") == F.col("alternative_code")))
    out = met.select("program_id", F.col("course_code").alias("code"), F.coalesce(F.nullif(F.trim("extracted_title"), F.lit("")), "canonical_name").alias("course_name"), "course_type", F.col("section").alias("description"), "staging_id")
    return latest_per_key(out, ["program_id", "code"], [F.desc("staging_id")]).drop("staging_id")


def scoped(df: DataFrame, program_id: int | None = None, limit: int | None = None, order: str = "staging_id") -> DataFrame:
    """The staged rows of one programme, or of all; the first ``limit`` of them by ``order`` if that is asked for."""
    own = df if program_id is None else df.where(F.col("program_id") == program_id)
    return own if limit is None else own.orderBy(order).limit(limit)


def rebuild_links(spark: SparkSession, staging: DataFrame, courses: DataFrame, path: str, program_id: int | None = None, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """Rebuild the final links at ``path``, of one programme or of all, from the staged references; (action, n) of what is done.

    A programme's links are replaced as a partition, all links as a table. With ``dry_run`` nothing is written, and the
    counts tell what would be.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001
    old = spark.read.parquet(path) if there else None
    gone = 0 if old is None else (old if program_id is None else old.where(F.col("program_id") == program_id)).count()
    new = persist_shared(staging_to_final(scoped(staging, program_id, limit), courses), "links")
    counts = [("deleted", gone), ("inserted", new.count())]
    if not dry_run:
        if program_id is None:
            new.repartition("program_id").write.mode("overwrite").partitionBy("program_id").parquet(path)
        elif counts[1][1]:
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("program_id").parquet(path)
        elif gone:
            own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/program_id={program_id}")  # noqa: SLF001
            own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)  # noqa: SLF001
    return spark.createDataFrame(counts, "action string, n long")


def rebuild_stored_links(links: StoredTable, staging: DataFrame, courses: DataFrame, program_id: int | None = None, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """As ``rebuild_links`` for links in a stored table: the old ones go and the new ones come in one version, which a lost driver leaves out as a whole.

    A dry run only counts the new links, without making their columns.
    """
    own = F.lit(True) if program_id is None else F.col("program_id") == program_id
    new = staging_to_final(scoped(staging, program_id, limit), courses)
    new = new if dry_run else persist_shared(new, "links")
    counts = [("deleted", links.read().where(own).count()), ("inserted", new.count())]
    if not dry_run:
        links.replace(own, new)
    return new.sparkSession.createDataFrame(counts, "action string, n long")


def flatten_documents(items: DataFrame) -> DataFrame:
    """One row per item and document address, from documents (url, label), file_urls and files (url, path, checksum, status).

    Labels and file facts are looked up by address; order is by first mention.
    """
    urls = F.array_distinct(F.concat(F.coalesce(F.transform("documents", lambda d: d["url"]), F.array().cast("array<string>")), F.coalesce("file_urls", F.array().cast("array<string>"))))
    rows = items.select("*", F.posexplode(F.filter(urls, lambda u: F.coalesce(F.trim(u), F.lit("")) != "")).alias("position", "document_url"))
    doc = F.get(F.filter("documents", lambda d: d["url"] == F.col("document_url")), 0)
    file = F.get(F.filter("files", lambda d: d["url"] == F.col("document_url")), 0)
    return rows.select(*[c for c in items.columns if c not in ("documents", "file_urls", "files")], "position", "document_url", doc["label"].alias("document_label"), file["path"].alias("path"), file["checksum"].alias("checksum"), file["status"].alias("file_status"))


def dedupe_last_first_place(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of every key, standing where the key stood first (``seq`` is the first row's)."""
    others = [c for c in df.columns if c not in (*keys, seq)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("r"), F.min(seq).alias(seq)).select(*keys, "r.*", seq).select(*df.columns)


def attach_documents(matches: DataFrame, warn: int = 15) -> DataFrame:
    """(programme_index, documents, n_documents, too_many): a programme's documents by falling score, label and address."""
    one = F.struct((-F.col("score")).alias("order"), "document_label", "document_url", "score")
    docs = F.transform(F.array_sort(F.collect_list(one)), lambda d: F.struct(d["document_label"].alias("label"), d["document_url"].alias("url"), d["score"].alias("score")))
    out = matches.groupBy("programme_index").agg(docs.alias("documents"))
    return out.withColumn("n_documents", F.size("documents")).withColumn("too_many", F.col("n_documents") > warn)


def fan_out_credits(programmes: DataFrame, column: str = "ects_values", name: str = "ects_points") -> DataFrame:
    """One row per credit value; programmes without any keep one row of null."""
    return programmes.select("*", F.explode_outer(column).alias(name)).drop(column)


def patch_by_rules(unmatched: DataFrame, programmes: DataFrame, rules: list[dict]) -> DataFrame:
    """Documents that match a rule's words, joined with the programme of the rule's name and level of highest or lowest credits.

    A rule has pattern, name, level and pick ("highest" or "lowest"); the first rule that fits a document wins.
    """
    which = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules))):
        which = F.when(F.lower("document_label").rlike(r["pattern"]), i).otherwise(which)
    spark = unmatched.sparkSession
    table = spark.createDataFrame([(i, r["name"].lower(), r["level"], r.get("pick", "highest")) for i, r in enumerate(rules)], "rule int, rule_name string, rule_level string, pick string")
    p = programmes.join(F.broadcast(table), (F.lower("programme") == F.col("rule_name")) & (F.col("level") == F.col("rule_level")))  # a hand-written rule table
    chosen = latest_per_key(p, ["rule"], [F.when(F.col("pick") == "highest", -F.col("ects_points")).otherwise(F.col("ects_points")), F.asc("programme_index")])
    return unmatched.withColumn("rule", which).where("rule is not null").join(F.broadcast(chosen.select("rule", "programme_index", "ects_points")), "rule")


def day_time_info(offering_type: Column, times: Column, structure: Column, contact: Column, dates: Column) -> Column:
    """The free text of an offering's times: the days of its dates, else the blocks of its text, else what is said of a block course.

    ``dates`` is a list of (date, time, unit_type) with dates as dd.mm.yyyy.
    """
    from lectern.functions.values import swiss_date, time_range, weekday_name

    def slot(d: Column) -> Column:
        t = time_range(d["time"])
        unit = F.when(F.coalesce(F.trim(d["unit_type"]), F.lit("")) != "", F.concat(F.lit(" ("), F.trim(d["unit_type"]), F.lit(")"))).otherwise("")
        return F.concat(weekday_name(swiss_date(d["date"])), F.lit(" "), t["start"], F.lit(" - "), t["end"], unit)

    by_dates = F.array_join(F.array_distinct(F.array_compact(F.transform(F.coalesce(dates, F.array().cast("array<struct<date:string,time:string,unit_type:string>>")), slot))), "; ")
    part = lambda k: F.regexp_extract_all(times, F.lit(T._BLOCK), F.lit(k))  # noqa: E731, SLF001
    zipped = F.arrays_zip(part(1).alias("d"), part(2).alias("h1"), part(3).alias("m1"), part(4).alias("h2"), part(5).alias("m2"))
    named = F.transform(zipped, lambda z: F.concat(T.english_day(z["d"]), F.lit(" "), F.lpad(z["h1"], 2, "0"), F.lit(":"), z["m1"], F.lit(" - "), F.lpad(z["h2"], 2, "0"), F.lit(":"), z["m2"]))
    by_text = F.array_join(F.array_distinct(named), "; ")
    hours = F.concat(F.nullif(F.regexp_extract(contact, r"(\d+)", 1), F.lit("")), F.lit(" hours total"))
    block = F.nullif(F.array_join(F.array_compact(F.array(F.nullif(F.trim(structure), F.lit("")), hours)), ", "), F.lit(""))
    other = F.when(F.coalesce(F.trim(times), F.lit("")) != "", F.when(F.lower(times).rlike("unregelmässig|irrégulier"), "Irregular schedule").otherwise("Block course"))
    weekly = F.coalesce(F.nullif(by_dates, F.lit("")), F.nullif(by_text, F.lit("")), F.nullif(F.trim(times), F.lit("")))
    return F.when(offering_type == "Weekly", weekly).otherwise(F.coalesce(block, other))


def offering_type(times: Column, dates: Column) -> Column:
    """Weekly or Block by words of the times; else Block if there are single dates."""
    x = F.lower(F.coalesce(times, F.lit("")))
    return F.when(x.rlike("wöchentlich|weekly|hebdomadaire|bi-mensuel"), "Weekly").when(x.rlike("bloc"), "Block").when(F.coalesce(F.size(dates), F.lit(0)) > 0, "Block").otherwise("Weekly")


def run_steps(steps: list[tuple[str, Callable[[], None]]], start: str | None = None, stop: str | None = None, skip: set[str] = frozenset(), done: Callable[[str], bool] = lambda _: False, retries: int = 1) -> list[tuple[str, str]]:
    """Run named steps in order between ``start`` and ``stop``; (name, ran / skipped) of each. A step that fails is tried again."""
    names = [n for n, _ in steps]
    lo, hi = names.index(start) if start else 0, names.index(stop) if stop else len(names) - 1
    out = []
    for i, (name, run) in enumerate(steps):
        if not lo <= i <= hi or name in skip or done(name):
            out.append((name, "skipped"))
            continue
        for attempt in range(retries + 1):
            try:
                run()
                break
            except Exception:
                if attempt == retries:
                    raise
        out.append((name, "ran"))
    return out
