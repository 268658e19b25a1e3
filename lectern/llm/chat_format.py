"""Chat transcripts to canonical turns: a hidden Markov model over speaker markers and line features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import arrow_batches, persist_shared
from lectern.operators.grouped import per_group

ROLES = ("system", "user", "assistant")
#: The words that mark speakers, by the style of the transcript: (system, user, assistant).
FAMILIES = {
    "plain": (("system",), ("user",), ("assistant",)),
    "human": (("system",), ("human",), ("ai", "assistant")),
    "letters": (("system", "instruction", "instructions", "context"), ("q",), ("a",)),
    "questions": (("system", "instruction", "instructions", "context"), ("question",), ("answer",)),
    "support": (("system",), ("customer", "client"), ("agent",)),
    "bot": (("system",), ("user", "prompter"), ("bot", "chatbot", "gpt")),
}
#: Styles without words of their own: no turn is marked, or turns are marked by any of the words.
UNMARKED, MIXED = len(FAMILIES), len(FAMILIES) + 1
STYLES_KNOWN = len(FAMILIES) + 2
WORDS = sorted({w for roles in FAMILIES.values() for ws in roles for w in ws})
#: Role of a word wherever it marks a turn.
ROLE_OF = {w: r for roles in FAMILIES.values() for r, ws in enumerate(roles) for w in ws}
_NUMBER = {w: i for i, w in enumerate(WORDS)}
NO_WORD = len(WORDS)
_MARKER = re.compile(r"[\s\[(*<#|>]*([A-Za-z]+)[\s\])*>|]*:[\])*>|]*\s?")
#: States: the role's first line, then the role's further lines.
N = len(ROLES)
STATES = 2 * N
#: Line features beside the marker: blank line / question / other, and length class.
SIZES = (3, 4)
#: Conversations, as expected number, that a fit reads.
TRAIN_CONVERSATIONS = 5_000
#: Lines of one chunk of a transcript; longer transcripts are decoded chunk by chunk.
CHUNK = 1024
#: Share of every learnt distribution that is spread evenly, at every size of the training data.
EVEN = 0.02
#: Prior share of unmarked transcripts, and of those that mix words.
RARE = (0.02, 1e-4)
NEVER = 1e-30


def marker(line: str | None) -> tuple[int, int]:
    """(number of the line's marker word or NO_WORD, characters of the marker)."""
    m = _MARKER.match(line or "")
    k = _NUMBER.get(m.group(1).lower(), NO_WORD) if m else NO_WORD
    return k, m.end() if k != NO_WORD else 0


def features(line: str | None) -> tuple[int, int, int]:
    """(marker word, blank line / question / other, length class)."""
    line = line or ""
    kind = 0 if not line.strip() else 1 if line.rstrip().endswith("?") else 2
    return marker(line)[0], kind, min(3, len(line) // 100)


@dataclass
class TranscriptModel:
    """Log probabilities: ``start`` (style x state), ``step`` (state x state), ``words`` (style x state x word), ``emit`` (per feature: state x value).

    A path stays in one style: the style tells which words open turns in this transcript, so that others are content.
    """

    start: np.ndarray
    step: np.ndarray
    words: np.ndarray
    emit: list[np.ndarray]

    def scores(self, lines: list[str | None]) -> np.ndarray:
        """Log likelihood (line x style x state) of every line under every style and state."""
        f = np.array([features(x) for x in lines]).reshape(-1, 1 + len(self.emit))
        other = sum(e[:, f[:, k + 1]].T for k, e in enumerate(self.emit))
        return self.words[:, :, f[:, 0]].transpose(2, 0, 1) + other[:, None, :]

    def transfer(self, scores: np.ndarray, first: bool) -> np.ndarray:
        """Best score of a chunk, by style, from every state before it to every state at its end."""
        m = np.repeat(self.start[:, None, :], STATES, 1) if first else np.repeat(self.step[None], STYLES_KNOWN, 0)
        m = m + scores[0][:, None, :]
        for s in scores[1:]:
            m = (m[:, :, :, None] + self.step[None, None]).max(2) + s[:, None, :]
        return m

    def decode(self, scores: np.ndarray, before: int | None, last: int | None) -> list[int]:
        """The best states (style * STATES + state) of a chunk given the one before it (None: the transcript's start) and its last one."""
        if before is None:
            v = self.start + scores[0]
        else:
            v = np.full((STYLES_KNOWN, STATES), -np.inf)
            v[before // STATES] = self.step[before % STATES] + scores[0][before // STATES]
        back = []
        for s in scores[1:]:
            m = v[:, :, None] + self.step[None]
            back.append(m.argmax(1))
            v = m.max(1) + s
        end = int(v.argmax()) if last is None else last
        style, path = end // STATES, [end % STATES]
        for b in reversed(back):
            path.append(int(b[style, path[-1]]))
        return [style * STATES + s for s in reversed(path)]


def _even(counts: np.ndarray, share: float = EVEN) -> np.ndarray:
    """Distributions along the last axis, ``share`` of each spread evenly; without counts all of it."""
    total = counts.sum(-1, keepdims=True)
    learnt = np.divide(counts, total, out=np.full_like(counts, 1 / counts.shape[-1]), where=total > 0)
    return (1 - share) * learnt + share / counts.shape[-1]


def model_from_counts(counts: dict[tuple, float]) -> TranscriptModel:
    """Probabilities of counted keys: ("t", role or -1, role), ("c", state, goes on 0/1), ("e", feature, state, value), ("m", state, word).

    The styles' shares, the words that open turns, turns without a marker and words inside turns are all learnt, and
    mixed with a fixed share of even distributions, so that a model of many conversations is as tolerant as one of few.
    A word of the transcript's own style always opens a turn of its own role.
    """
    roles, goes, emit, words = np.zeros((N + 1, N)), np.zeros((STATES, 2)), [np.zeros((STATES, n)) for n in SIZES], np.zeros((STATES, NO_WORD + 1))
    for key, n in counts.items():
        if key[0] == "t":
            roles[key[1], key[2]] += n
        elif key[0] == "c":
            goes[key[1], key[2]] += n
        elif key[0] == "e":
            emit[key[1]][key[2], key[3]] += n
        else:
            words[key[1], key[2]] += n
    if not roles.any():  # nothing known: users speak first, and the two take turns
        roles[-1, 1] = roles[0, 1] = roles[1, 2] = roles[2, 1] = 1
    roles, goes = _even(roles, 5 * EVEN), _even(goes, 5 * EVEN)
    step = np.full((STATES, STATES), NEVER)
    for s in range(STATES):
        step[s, s % N + N] = goes[s, 1]
        step[s, :N] = goes[s, 0] * roles[s % N]
    opened = words[:N].sum(0)
    silent = _even(np.array([1 + opened[:NO_WORD].sum(), opened[NO_WORD]]), EVEN / 20)[1]  # a speaker may rather go on twice
    inner = _even(np.array([1 + words[N:, NO_WORD].sum(), words[N:, :NO_WORD].sum()]), 5 * EVEN)[1]
    table = np.full((STYLES_KNOWN, STATES, NO_WORD + 1), NEVER)
    used = np.zeros(len(FAMILIES))
    for f, own in enumerate(FAMILIES.values()):
        mine = [_NUMBER[w] for ws in own for w in ws]
        used[f] = sum(words[r, _NUMBER[w]] for r in (1, 2) for w in own[r]) / sum(len(own[r]) for r in (1, 2))
        for r, ws in enumerate(own):
            at = [_NUMBER[w] for w in ws]
            table[f, r, at] = (1 - silent) * _even(words[r, at], 0.1)
            table[f, r, NO_WORD] = silent
        foreign = [k for k in range(NO_WORD) if k not in mine]
        table[f, N:, foreign] = inner / max(1, len(foreign))
        table[f, N:, NO_WORD] = 1 - inner
    table[UNMARKED, :, :NO_WORD] = inner / NO_WORD / 100  # many marker words speak against this style, even if one speaker has them all
    table[UNMARKED, :, NO_WORD] = 1 - inner
    for r in range(N):
        at = [k for k, w in enumerate(WORDS) if ROLE_OF[w] == r]
        table[MIXED, r, at] = (1 - silent) / len(at)
        table[MIXED, r, NO_WORD] = silent
    table[MIXED, N:, NO_WORD] = 1
    style = np.concatenate([(1 - sum(RARE)) * _even(used, 0.2), RARE])
    start = np.full((STYLES_KNOWN, STATES), NEVER)
    start[:, :N] = style[:, None] * roles[-1]
    return TranscriptModel(np.log(start), np.log(step), np.log(table), [np.log(_even(e)) for e in emit])


def fit(lines: DataFrame, n: int = TRAIN_CONVERSATIONS) -> TranscriptModel:
    """Count what about ``n`` labelled conversations show (chosen by a hash of the id): speakers' order, markers and line features.

    ``lines`` is as ``transcripts`` gives it, with the role that each line's turn has. Turns of unknown role and lines of
    null conv_id teach nothing. Where several turns share a position, the least role stands for it in the speakers' order.
    """
    arrow_batches(lines.sparkSession)
    known = lines.where("conv_id is not null").where(F.col("role").isin(*ROLES))
    total = max(1, known.agg(F.approx_count_distinct("conv_id")).first()[0])
    share = int(1_000_000 * min(1.0, n / total))
    part = known.where(F.pmod(F.xxhash64("conv_id"), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for role, opens, line in zip(*(c.to_pylist() for c in b.columns)):
                state = ROLES.index(role) + (0 if opens else N)
                found = features(line)
                seen["m", state, found[0], -1] += 1
                for i, v in enumerate(found[1:]):
                    seen["e", i, state, v] += 1
        keys = list(seen)
        columns = [[k[i] for k in keys] for i in range(4)] + [list(seen.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] + [pa.int64()] * 4)], names=["what", "a", "b", "c", "n"])

    flat = part.select("role", F.col("line_no") == F.col("opened_at"), "line")
    seen = flat.mapInArrow(count, "what string, a long, b long, c long, n long").groupBy("what", "a", "b", "c").agg(F.sum("n").alias("n")).collect()  # bounded by the features' values
    counts: dict[tuple, float] = {tuple(v for v in (r.what, r.a, r.b, r.c) if v != -1): float(r.n) for r in seen}
    turns = part.groupBy("conv_id", "pos", "tie", "opened_at").agg(F.min("role").alias("role"), F.count("*").alias("lines"))
    for r in turns.groupBy("role").agg(F.count("*").alias("n"), F.count(F.when(F.col("lines") > 1, 1)).alias("long"), F.sum("lines").alias("lines")).collect():
        k, more = ROLES.index(r.role), r.lines - r.n
        counts |= {("c", k, 1): float(r.long), ("c", k, 0): float(r.n - r.long), ("c", k + N, 1): float(more - r.long), ("c", k + N, 0): float(r.long)}
    spoken = turns.where("pos >= 0").groupBy("conv_id", "pos").agg(F.min("role").alias("role"))
    before = spoken.select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("role").alias("before"))
    for r in spoken.join(before, ["conv_id", "pos"], "left").groupBy("before", "role").agg(F.count("*").alias("n")).collect():
        counts["t", -1 if r.before is None else ROLES.index(r.before), ROLES.index(r.role)] = float(r.n)
    return model_from_counts(counts)


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their number within the transcript (``at``, from 0), by a sort of ranges and the sizes of its parts.

    No transcript is gathered in one task: the ranges cut within transcripts, positions and turns alike.
    """
    order = ["conv", "pos", "tie", "line_no"]
    row = F.monotonically_increasing_id()
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({"part": F.shiftright(row, 33), "row": row.bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = persist_shared(ranged, "transcript-lines")
    sizes = sorted(ranged.groupBy("part").agg(F.count("*").alias("n")).collect())  # as many numbers as partitions
    starts, so_far = {}, 0
    for part, n in sizes:
        starts[part], so_far = so_far, so_far + n
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), F.col("part")) if starts else F.lit(0)
    placed = ranged.withColumn("whole", offset + F.col("row"))
    return placed.join(placed.groupBy("conv").agg(F.min("whole").alias("head")), "conv").select("conv", "line", (F.col("whole") - F.col("head")).alias("at"))


def parse(lines: DataFrame, model: TranscriptModel) -> DataFrame:
    """(conv_id, turn_no, role, content, rendered): the turns that the lines of transcripts make.

    ``lines`` has conv_id, pos, tie, line_no (longs, the order of lines) and line; other columns are ignored. Style and roles come from
    the best path of states; the marker of a turn's first line is taken off only where the path's style has its word. A
    transcript is cut into chunks of CHUNK lines: every chunk gives the best scores between all states, one pass over
    these small matrices fixes the states at the chunks' ends, and the chunks are decoded apart. So one long
    transcript is many tasks' work. Null lines count as blank; lines of null conv_id are one transcript; lines of equal
    order may change places; of paths that score alike the first style and state win. An empty table has no turns.
    """
    spark = lines.sparkSession
    arrow_batches(spark)
    named = lines.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "pos", "tie", "line_no", F.col("line").cast("string").alias("line"))
    cut = _numbered(named).withColumn("chunk", F.floor(F.col("at") / CHUNK).cast("long"))

    def matrix(rows: list) -> list[tuple]:
        r = rows[0]
        return [(r.conv, r.chunk, model.transfer(model.scores([x.line for x in rows]), r.chunk == 0).tobytes())]

    long = cut.where("chunk = 1").select("conv").distinct()
    matrices = per_group(cut.join(long, "conv", "left_semi").select("conv", "chunk", "at", "line"), ["conv", "chunk"], ["at"], matrix, "conv string, chunk long, m binary")

    def ends(rows: list) -> list[tuple]:
        """Viterbi over the chunks' matrices, each style for itself: (state before, state at the end) of every chunk."""
        shape = (STYLES_KNOWN, STATES, STATES)
        v, back = np.frombuffer(rows[0].m).reshape(shape)[:, 0], []
        for r in rows[1:]:
            s = v[:, :, None] + np.frombuffer(r.m).reshape(shape)
            back.append(s.argmax(1).astype(np.int8))
            v = s.max(1)
        best = int(v.argmax())
        style, last = best // STATES, [best % STATES]
        for b in reversed(back):
            last.append(int(b[style, last[-1]]))
        last = [style * STATES + s for s in reversed(last)]
        return [(r.conv, r.chunk, b, e) for r, b, e in zip(rows, [-1, *last], last)]

    fixed = per_group(matrices, ["conv"], ["chunk"], ends, "conv string, chunk long, before int, last int")

    def states(rows: list) -> list[tuple]:
        r = rows[0]
        path = model.decode(model.scores([x.line for x in rows]), None if r.before < 0 else r.before, None if r.last < 0 else r.last)
        out, no = [], 0
        for x, s in zip(rows, path):
            style, state, line = s // STATES, s % STATES, x.line or ""
            opens = state < N
            no += opens
            word, size = marker(line) if opens else (NO_WORD, 0)
            own = size and style != UNMARKED and ROLE_OF[WORDS[word]] == state
            out.append((x.conv, x.chunk, x.at, ROLES[state % N], no, line[size:] if own else line))
        return out

    joined = cut.join(fixed, ["conv", "chunk"], "left").select("conv", "chunk", "at", "line", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("last", F.lit(-1)).alias("last"))
    decoded = persist_shared(per_group(joined, ["conv", "chunk"], ["at"], states, "conv string, chunk long, at long, role string, no long, text string"), "decoded-lines")
    counts = decoded.groupBy("conv", "chunk").agg(F.max("no").alias("turns"))
    base = F.sum("turns").over(Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))  # one row a chunk
    placed = decoded.join(counts.select("conv", "chunk", F.coalesce(base, F.lit(0)).alias("base")), ["conv", "chunk"])
    turns = placed.groupBy("conv", (F.col("base") + F.col("no") - 1).alias("turn_no")).agg(F.min("role").alias("role"), F.sort_array(F.collect_list(F.struct("at", "text"))).alias("all"))
    content = F.array_join(F.transform("all", lambda x: x["text"]), "\n")
    out = turns.select(F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), "turn_no", "role", content.alias("content"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>")))


#: How the query writes a role's first line: markers as they stand in the wild, by conversation.
STYLES = (("System", "User", "Assistant"), ("SYSTEM", "Human", "AI"), ("### Instruction", "Q", "A"), ("[system]", "**Customer**", "**Agent**"))


def transcripts(conversations: DataFrame, marked: Column | None = None) -> DataFrame:
    """Lines (conv_id, pos, tie, line_no, line) of transcripts, with the role of each and ``opened_at``, its turn's first line_no.

    From rows of (conv_id, turn, role, text): every turn's first line has a speaker marker, in a style that changes with
    the conversation; where ``marked``, a condition on the conversations' columns, is false there is none. Turns of
    unknown or null role have no marker. Turns of equal number follow a hash of role and text, and rows that repeat all
    values stay as turns of their own; null texts are empty; null turns stand first; null conv_ids are one conversation.
    """
    rows = conversations.select("conv_id", "turn", F.lower("role").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.lit(True) if marked is None else F.coalesce(marked, F.lit(False))).alias("marked"))
    rows = rows.groupBy("conv_id", "turn", "role", "text", "marked").agg(F.count("*").alias("copies"))
    style = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(len(STYLES)))
    named = [F.when(F.col("marked") & (style == k) & (F.col("role") == r), F.lit(f"{name}: ")) for k, names in enumerate(STYLES) for r, name in zip(ROLES, names)]
    all_lines = F.split(F.concat(F.coalesce(*named, F.lit("")), F.col("text")), "\n")
    rows = rows.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("pos"), F.xxhash64("role", "text").alias("tie"), "role", all_lines.alias("lines"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    opened = (F.col("copy") * F.size("lines")).cast("long")
    split = rows.select("conv_id", "pos", "tie", "role", opened.alias("opened_at"), F.posexplode("lines").alias("k", "line"))
    return split.select("conv_id", "pos", "tie", (F.col("opened_at") + F.col("k")).alias("line_no"), "line", "role", "opened_at")


#: The query's turns by plain SQL: the round trip gives back the conversations' own roles and texts.
ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, lower(role) AS role, COALESCE(text, '') AS content FROM conversations)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS BIGINT) AS turn_no, role, content,
       '<|' || role || '|>' || chr(10) || content || chr(10) || '<|end|>' AS rendered FROM t
"""
