"""Study plans: equivalent courses, semesters, credits, timetables and conflicts."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators.graph import connected_components
from lectern.operators.grouped import per_group
from lectern.operators.relational import jaccard

# ---- equivalence (courses that count once) ----

#: Words that say nothing about a title's subject, and the similarity of titles that are one course.
TITLE_STOPWORDS = ["in", "de", "des", "der", "die", "das", "a", "the", "and", "et", "en", "of", "for", "to", "course", "cours"]
SAME_TITLE, NEIGHBOUR_TITLE = 0.72, 0.45
#: Titles in other languages, in this order. Single letters and "de" are gone from a normalised title.
TITLES = [
    ("wirtschaftsinformatik|informatique gestion", "business informatics"), ("information systems?", "business informatics"), ("einfuehrung|einfuhrung|introduction|introductory", "introduction"),
    ("statistique|statistik|statistics?", "statistics"), ("vertiefungskurs|approfondissement|advanced", "advanced"), ("mathematiques?|mathematik|mathematics?", "mathematics"),
    ("betriebswirtschaftslehre|gestion entreprise|business administration", "business administration"), ("bilanzierung|comptabilite financiere|financial accounting", "financial accounting"),
    ("controlling|comptabilite gestion|management accounting", "management accounting"), ("unternehmensrechnung|comptabilite", "accounting"), ("recht|droit|law", "law"),
    ("mikrookonomie|microeconomie|microeconomics?", "microeconomics"), ("investissement|investitions|investition|investment", "investment"), ("unternehmensfinanzierung|finance entreprise|corporate finance", "corporate financing"),
    ("financement|finanzierung|financing|finance", "financing"), ("marketingforschung|recherche marketing|marketing research", "marketing research"),
    ("gestion ressources humaines|ressources humaines|human resource management", "human resource management"), ("organisation|organization", "organisation"), ("kompetenz|competences|competence", "competence"),
    ("documentaires?|documentary", "documentary"), ("informationskompetenz", "information competence"), ("wirtschaftswissenschaften|economie|economics?", "economics"),
]


def title_key(c):  # noqa: ANN001, ANN201
    """A course title for comparison across languages."""
    return T.substitute(T.normalize_plan(c), TITLES)


def equivalent_pairs(courses: DataFrame) -> DataFrame:
    """(plan, a, b) of courses of one plan that are one course in two languages.

    ``courses``: plan, row_no, code, name, ects, course_type, section, semester_types, languages (lists). Courses pair
    if type and credits agree and their semesters meet (an empty list meets all), and either their keys or
    titles agree, or one is German and the other French with similar titles, or they are neighbours in one
    section with a fairly similar title. The join is by plan, type and credits.
    """
    x = courses.select(
        "plan", "row_no", "name", F.coalesce("ects", F.lit(0.0)).alias("ects"), "course_type", T.normalize_plan(F.col("section")).alias("section"), "semester_types",
        title_key(F.col("name")).alias("title"), F.transform("languages", T.normalize_plan).alias("languages"),
    )
    german = F.arrays_overlap("languages", F.array(*[F.lit(v) for v in ("deutsch", "german", "allemand")]))
    french = F.arrays_overlap("languages", F.array(*[F.lit(v) for v in ("franzosisch", "franzoesisch", "french", "francais")]))
    x = x.withColumns({"de": F.coalesce(german, F.lit(False)), "fr": F.coalesce(french, F.lit(False)), "words": T.tokens(F.col("title"), TITLE_STOPWORDS)})
    p, q = x.alias("p"), x.alias("q")
    same = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in ("plan", "course_type", "ects")]
    semesters = (F.size("p.semester_types") == 0) | (F.size("q.semester_types") == 0) | F.arrays_overlap("p.semester_types", "q.semester_types")
    likeness = jaccard(F.col("p.words"), F.col("q.words"))
    title = F.col("p.title") == F.col("q.title")
    neighbours = F.col("q.row_no") - F.col("p.row_no") == 1
    two_languages = (F.col("p.de") & F.col("q.fr")) | (F.col("p.fr") & F.col("q.de"))
    near = (neighbours | two_languages) & (likeness >= SAME_TITLE)
    side_by_side = neighbours & two_languages & (F.col("p.section") == F.col("q.section")) & (likeness >= NEIGHBOUR_TITLE)
    pairs = p.join(q, same[0] & same[1] & same[2] & (F.col("p.row_no") < F.col("q.row_no")) & semesters & (title | near | side_by_side))
    return pairs.select("p.plan", F.col("p.row_no").alias("a"), F.col("q.row_no").alias("b"))


def equivalence_groups(courses: DataFrame) -> DataFrame:
    """``courses`` with ``group_no``, the least row_no of the row's class; row_no must be unique over all plans."""
    parts = connected_components(equivalent_pairs(courses)).withColumnRenamed("id", "row_no")
    return courses.join(parts, "row_no", "left").withColumn("group_no", F.coalesce("component", "row_no")).drop("component")


def roll_up(courses: DataFrame) -> DataFrame:
    """One row of each group: choice flag, credits and title of the first option, least year and part, all semester types.

    Most groups are one course, so groups are sorted once and read in order; an aggregate of lists would sort them on both sides of its shuffle.
    """
    w = Window.partitionBy("plan", "group_no").orderBy(F.asc_nulls_last("row_no"))
    all_of = lambda c: c.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = courses.select("plan", "group_no", "row_no", "ects", "course_type", "semester_types", "suggested_year", "code", T.sequence_part(F.col("name")).alias("_part"), T.series_key(F.col("name")).alias("_series"), T.time_blocks(F.col("day_time_info")).alias("_blocks"))
    x = x.withColumns({
        "_place": F.row_number().over(w), "_n": all_of(F.count(F.lit(1))), "_year": all_of(F.min("suggested_year")), "_sequence": all_of(F.min(F.coalesce("_part", F.lit(50)))),
        "_types": all_of(F.collect_list("semester_types")), "_codes": all_of(F.collect_list("code")), "_all_blocks": all_of(F.collect_list("_blocks")),
    })
    return x.where("_place = 1").select(
        "plan", "group_no", (F.col("_n") > 1).alias("requires_choice"), F.coalesce("ects", F.lit(0.0)).alias("planned_ects"), F.col("_year").alias("suggested_year"),
        F.array_sort(F.array_distinct(F.flatten("_types"))).alias("semester_types"), F.col("_sequence").alias("sequence"), F.col("_series").alias("series"), F.col("_part").alias("part"),
        F.col("row_no").alias("source_order"), "course_type", F.array_sort("_codes").alias("codes"), F.array_distinct(F.flatten("_all_blocks")).alias("blocks"),
    )


# ---- slotting ----


@dataclass
class Slot:
    number: int
    load: float = 0.0
    groups: list = field(default_factory=list)
    electives: int = 0

    @property
    def kind(self) -> str:
        return "Autumn" if self.number % 2 else "Spring"


def _clash(x, y) -> bool:  # noqa: ANN001
    for a in x:
        for b in y:
            if a["day"] == b["day"] and a["start"] < b["end"] and b["start"] < a["end"]:
                return True
    return False


class Planner:
    """Semesters filled one group after the other.

    A semester aims at total / semesters credits, 20 % more or less. A mandatory group goes to the first
    semester that is still below the band and stays within it, else to the least loaded that stays within
    it, else to where it overshoots least. Electives go to the last two fifths.
    """

    def __init__(self, semesters: int, total: float | None):
        target = (total if total and total > 0 else 180) / semesters
        self.low, self.high = target * 0.8, target * 1.2
        self.slots = [Slot(i + 1) for i in range(semesters)]

    def _open(self, g, least: int) -> list[Slot]:  # noqa: ANN001
        kinds = list(g.semester_types) if g.semester_types is not None else []
        return [s for s in self.slots if s.number >= least and (not kinds or s.kind in kinds) and not any(_clash(g.blocks, o.blocks) for o in s.groups)]

    def mandatory(self, groups: list) -> None:
        """Groups in order of year, source, series and part; a later part follows its earlier one."""
        nothing = lambda v, d: d if v is None or v != v else v
        last: dict[str, int] = {}
        for g in sorted(groups, key=lambda g: (nothing(g.suggested_year, 99), g.source_order, g.series, nothing(g.part, 999), g.sequence)):
            year, part = nothing(g.suggested_year, None), nothing(g.part, None)
            base = max(1, int((year - 1) * 2 + 1)) if year else 1
            after = max(base, last[g.series] + 1) if part and part > 1 and g.series in last else base
            choice = self._open(g, after) or (after > base and self._open(g, base)) or (base > 1 and self._open(g, 1)) or self.slots
            e = g.planned_ects
            fits = [s for s in choice if s.load + e <= self.high]
            light = [s for s in fits if s.load < self.low]
            if light:
                slot = light[0]
            elif fits:
                slot = min(fits, key=lambda s: (s.load, s.number))
            else:
                slot = min(choice, key=lambda s: (max(0.0, s.load + e - self.high), s.load, s.number))
            slot.groups.append(g)
            slot.load += e
            if g.series and part is not None:
                last[g.series] = slot.number

    def electives(self, groups: list, chosen: bool) -> None:
        """Electives by year and part; ``chosen`` ones are placed even where the band is full."""
        start = max(1, min(len(self.slots), math.ceil(len(self.slots) * 0.6)))
        for g in sorted(groups, key=lambda g: (99 if g.suggested_year is None or g.suggested_year != g.suggested_year else g.suggested_year, g.sequence, g.source_order)):
            late = self._open(g, start)
            options = [s for s in late if s.load + g.planned_ects <= self.high] or (chosen and (late or self._open(g, 1))) or []
            if options:
                slot = min(options, key=lambda s: (s.load, s.number))
                if chosen or slot.load < self.low or slot.electives < 2:
                    slot.groups.append(g)
                    slot.electives += 1
                    slot.load += g.planned_ects


PLAN_SCHEMA = "plan long, semester_number int, semester_type string, group_no long, course_type string, planned_ects double, semester_ects double"


def plan_semesters(groups: DataFrame, semesters: int = 8, total: float | None = None, chosen: bool = False) -> DataFrame:
    """Place the groups (see ``roll_up``) of every plan; one plan is one task's work, plans are independent."""

    def place(rows: list) -> list[tuple]:
        p = Planner(semesters, total)
        p.mandatory([g for g in rows if g.course_type == "Mandatory"])
        p.electives([g for g in rows if g.course_type != "Mandatory"], chosen)
        return [(g.plan, s.number, s.kind, g.group_no, g.course_type, g.planned_ects, s.load) for s in p.slots for g in s.groups]

    used = groups.select("plan", "group_no", "course_type", "semester_types", "blocks", "planned_ects", "suggested_year", "source_order", "series", "part", "sequence")
    return per_group(used, ["plan"], ["group_no"], place, PLAN_SCHEMA)


# ---- credits ----


def suggest_courses(courses: DataFrame, target: float = 30.0, extra: int | None = None) -> DataFrame:
    """(plan, code) of the set of courses that comes nearest to ``target`` credits without a clash.

    ``courses``: plan, code, ects, mandatory, required, blocks. A knapsack over half credits up to target + 6 keeps
    the best set of every sum: nearest count (if ``extra`` is asked for), nearest credits, most mandatory
    courses, fewest courses. Required courses stand in every set; courses without credits are added at the end
    if they fit.
    """

    def choose(rows: list) -> list[tuple]:
        needed = sorted((r for r in rows if r.required), key=lambda r: r.code)
        have = {r.code for r in needed}
        free = [r for r in rows if r.code not in have]
        order = needed + sorted((r for r in free if r.ects > 0), key=lambda r: (not r.mandatory, -r.ects, r.code)) + sorted((r for r in free if r.ects <= 0), key=lambda r: r.code)
        # clashes[i] has a bit for every course that can't stand beside course i
        clashes = [0] * len(order)
        for i, a in enumerate(order):
            for j in range(i):
                if order[j].code != a.code and _clash(order[j].blocks, a.blocks):
                    clashes[i] |= 1 << j
                    clashes[j] |= 1 << i
        n = len(needed)

        def badness(state: tuple) -> tuple:
            _, credits, mandatory, positive, _ = state
            wanted = 0 if extra is None else abs(positive - n - extra)
            return wanted, abs(credits - target), -mandatory, positive

        # a set is (bits, credits, mandatory courses, courses with credits, (last course, set before it))
        start = (0, 0.0, 0, 0, None)
        fits = True
        for i in range(n):
            fits = fits and not clashes[i] & start[0]
            r = order[i]
            start = (start[0] | 1 << i, start[1] + r.ects, start[2] + bool(r.mandatory), start[3] + (r.ects > 0), (i, start[4]))
        if fits:
            most = int((target + 6) * 2)
            best = {round(start[1] * 2): start}
            ranks = {k: badness(s) for k, s in best.items()}
            for i in range(n, len(order)):
                r = order[i]
                if r.ects <= 0:
                    break
                units = round(r.ects * 2)
                for before, s in list(best.items()):
                    more = before + units
                    if more <= most and not clashes[i] & s[0]:
                        new = (s[0] | 1 << i, s[1] + r.ects, s[2] + bool(r.mandatory), s[3] + 1, (i, s[4]))
                        rank = badness(new)
                        if more not in best or rank < ranks[more]:
                            best[more], ranks[more] = new, rank
            start = min(best.values(), key=badness)
            for i in range(n, len(order)):
                if order[i].ects <= 0 and not clashes[i] & start[0]:
                    start = (start[0] | 1 << i, *start[1:4], (i, start[4]))
        picked, link = [], start[4]
        while link:
            picked.append(order[link[0]])
            link = link[1]
        return [(r.plan, r.code) for r in reversed(picked)]

    known = courses.withColumn("ects", F.coalesce(F.col("ects").cast("double"), F.lit(0.0)))
    return per_group(known, ["plan"], ["code"], choose, "plan long, code string")


# ---- timetables ----


def conflict_groups(blocks: DataFrame) -> DataFrame:
    """(plan, group_no, codes): sets of blocks that all overlap one another, of two courses at least.

    From every block in order of day, start, end and code a set is grown by each later block that meets all of
    it so far; sets within larger ones are left out. ``blocks``: plan, code, day, start, end. Blocks of the same time go together, so
    sets are grown over the different times of a plan's day, of which there are few, however many blocks it has: in that order a time meets all of
    a set if it starts before the first of them ends. The blocks join the sets afterwards.
    """
    same = ["plan", "day", "start", "end"]
    held = blocks.where("start <= end").groupBy(*same).agg(F.collect_set("code").alias("codes"))
    times = held.groupBy("plan", "day").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("times"))

    def grown(first: Column) -> Column:
        begin = F.struct(first["end"].alias("until"), F.array(first).alias("set"))
        step = lambda s, t: F.when((t > first) & (t["start"] < s["until"]), F.struct(F.least(s["until"], t["end"]).alias("until"), F.array_append(s["set"], t).alias("set"))).otherwise(s)
        return F.aggregate("times", begin, step, lambda s: s["set"])

    sets = times.withColumn("sets", F.transform("times", grown))
    # a set that begins later lies within one that begins earlier if that one holds all of it
    within = lambda s: F.exists("sets", lambda k: (k[0] < s[0]) & (F.size(F.array_except(s, k)) == 0))
    sets = sets.select("plan", "day", F.explode(F.filter("sets", lambda s: ~within(s))).alias("set"))
    rows = sets.select("plan", "day", F.col("set")[0].alias("first"), F.explode("set").alias("t")).select("plan", "day", "first", "t.start", "t.end")
    found = rows.join(held, same).groupBy("plan", "day", "first").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"), F.sum(F.size("codes")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("plan").orderBy(F.desc("n"), "day", "first")) - 1
    return found.where(F.size("codes") > 1).select("plan", rank.alias("group_no"), F.array_join("codes", ",").alias("codes"))


def lanes(blocks: DataFrame) -> DataFrame:
    """``blocks`` (plan, day, code, start, end) with the first free lane of each, in order of start, end and code."""

    def lay(group: list) -> list[tuple]:
        ends: list[int] = []
        out = []
        for r in group:
            k = next((i for i, x in enumerate(ends) if x <= r.start), len(ends))
            ends[k : k + 1] = [r.end]
            out.append((r.plan, r.day, r.code, r.start, r.end, k))
        return out

    return per_group(blocks, ["plan", "day"], ["start", "end", "code"], lay, "plan long, day string, code string, start int, end int, lane int")


def overlap_depth(df: DataFrame, keys: list[str], start: str, end: str, width: float = 1440.0) -> DataFrame:
    """(keys, depth): the largest number of half-open intervals that hold one moment.

    Starts and ends are counted in bins of ``width``: each bin's running sum rises from what the bins before it leave open,
    so that a key with very many intervals is as many tasks' work as it fills bins.
    """
    up = df.select(*keys, F.col(start).alias("t"), F.lit(1).alias("d"))
    down = df.select(*keys, F.col(end).alias("t"), F.lit(-1).alias("d"))
    steps = up.unionByName(down).groupBy(*keys, "t").agg(F.sum("d").alias("d")).withColumn("_bin", F.floor(F.col("t") / width))
    w = Window.partitionBy(*keys, "_bin").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    per = steps.withColumn("run", F.sum("d").over(w)).groupBy(*keys, "_bin").agg(F.max("run").alias("most"), F.sum("d").alias("left"))
    before = F.coalesce(F.sum("left").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("depth", F.col("most") + before).groupBy(*keys).agg(F.max("depth").alias("depth"))


def timetable(offerings: DataFrame) -> DataFrame:
    """(code, day, start, end) of offerings by their free text; those without a block get one row of nulls."""
    rows = offerings.select("code", F.explode_outer(T.time_blocks(F.col("day_time_info"))).alias("b"))
    return rows.select("code", "b.day", "b.start", "b.end")


#: How a room is named in a text of times.
ROOM = r"(?i)((?:raum|room|hörsaal|auditorium|seminarraum|pc-pool)\s*[a-z0-9-]*)"
_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")


def plan_timetable(offerings: DataFrame) -> DataFrame:
    """(plan, place, code, day, start, end, location, how) of every course of a plan, whatever is known of its times.

    ``offerings``: plan, place (0, 1, ... in the plan), code, offered, offering_type, day_time_info. How a row came about: ``text``, a block of the
    free text each; ``block``, a block course, which stands on Monday at 0:00; ``placed``, an offering without times, by its place: the five weekdays in turn,
    then two hours later; ``name``, a course without offering, the same with every second place an hour later. Courses that last past
    midnight keep their minutes. Rooms come from the text (a room's name, else its
    last part after a comma), else from the place.
    """
    info, place = F.col("day_time_info"), F.col("place")
    offered, blocks = F.coalesce("offered", F.lit(False)), F.coalesce(T.time_blocks(info), F.array().cast("array<struct<day:string,start:int,end:int>>"))
    how = F.when(~offered, "name").when(F.size("blocks") > 0, "text").when(F.lower("offering_type") == "block", "block").otherwise("placed")
    begin = (8 * 60 + F.floor(place / 5) * 120 + F.when(~offered & (place % 2 == 1), 60).otherwise(0)).cast("int")
    slot = lambda day, start, end: F.array(F.struct(day.alias("day"), start.alias("start"), end.alias("end")))
    by_place = slot(F.element_at(F.array(*map(F.lit, _DAYS)), (place % 5 + 1).cast("int")), begin, (begin + 120).cast("int"))
    slots = F.when(F.col("how") == "text", F.col("blocks")).when(F.col("how") == "block", slot(F.lit("Monday"), F.lit(0), F.lit(0))).otherwise(by_place)
    parts = F.filter(F.transform(F.split(info, ","), lambda x: F.trim(x)), lambda x: x != "")
    room = F.coalesce(F.nullif(F.trim(F.regexp_extract(info, ROOM, 1)), F.lit("")), F.when(F.size(parts) > 1, F.element_at(parts, -1)))
    default = F.concat(F.lit("Raum "), (place + 100).cast("string"))
    where = F.when(F.col("how") == "block", "Blockkurs").when(F.col("how") == "name", default).when(F.col("how") == "text", F.coalesce(room, F.lit(""))).otherwise(F.coalesce(room, default))
    rows = offerings.withColumn("blocks", blocks).withColumn("how", how).withColumn("location", where)
    return rows.select("plan", "place", "code", F.explode(slots).alias("b"), "location", "how").select("plan", "place", "code", "b.day", "b.start", "b.end", "location", "how")


def _run_at(n: int):  # noqa: ANN202
    return lambda i: F.array_join(F.slice("w", i, F.lit(n)), " ")


def mentioned(questions: DataFrame, courses: DataFrame) -> DataFrame:
    """(id, code): courses that a question names by code or by a part of the name (parts are divided by slashes).

    Names become rows of their normalised words and meet the questions' word runs of equal length, so that the
    join is by equality.
    """
    names = courses.select("code", F.explode(F.concat(F.array("code"), F.split("name", "/"), F.array("name"))).alias("n"))
    names = names.select("code", T.normalize_match(F.col("n")).alias("run")).where("run <> ''").distinct()
    lengths = [r[0] for r in names.select(F.size(F.split("run", " ")).alias("n")).distinct().collect()]  # as many as name lengths
    words = questions.select("id", F.split(T.normalize_match(F.col("text")), " ").alias("w"))
    runs = F.flatten(F.array(*[F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), _run_at(n))).otherwise(F.array().cast("array<string>")) for n in lengths])) if lengths else F.array().cast("array<string>")
    return words.select("id", F.explode(F.array_distinct(runs)).alias("run")).join(names, "run").select("id", "code").distinct()
