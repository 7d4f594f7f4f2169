"""Chat formatting: a hidden Markov model over lines recovers speaker roles by Viterbi, then turns are rendered.

States are (role, first line of a turn or a later one). A line's emission joins its speaker marker with its length, its
end and its place; transitions and emissions are counted over turns of known role. Conversations are chains over
rows in turn order; a role column is optional. Rows are dealt by ranges of (conversation, turn), so one conversation may span many partitions: each
partition sums up its border chains as (max, +) matrices, the driver joins these few matrices exactly, and every
partition then decodes its rows between known border states.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

ROLES = ("system", "user", "assistant")
# Names that speakers go by.
NAMES = {"system": "system instruction instructions context", "user": "user human customer person me question q prompter", "assistant": "assistant ai bot gpt model agent answer a response"}
ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role].split()}
MARKER = re.compile(r"^\s*(?:<\|(?:im_start\|>)?|#{1,4}\s*|\*\*|\[|<)?\s*(" + "|".join(sorted(ROLE_OF, key=len, reverse=True)) + r")\s*(?:\|>|\]|>|:\s*\*\*|\*\*\s*:?|:)[ \t]*", re.IGNORECASE)
CLOSING = re.compile(r"<\|(?:im_end|end|eot_id)\|>\s*$")
#: Chance that a speaker's marker is his own, at a turn's first line and later (quoted), and that there is none.
OWN, QUOTED = 0.97, 0.002
#: Rows of one range partition on average.
RANGE_ROWS = 100_000
N_FEATURES = 24
#: Conversations whose crc32 leaves another remainder than 0 by this number give the model of the registered query.
FOLDS = 5


def line_feature(line: str, place: int) -> int:
    """Class of a line by length, end and place in its row: 4 x 3 x 2 values."""
    n = len(line)
    size = 0 if n < 40 else 1 if n < 160 else 2 if n < 480 else 3
    tail = line.rstrip()[-1:]
    end = 0 if tail == "?" else 1 if tail in {".", "!", ""} else 2
    return (size * 3 + end) * 2 + (place > 0)


def split_marker(line: str) -> tuple[int, str]:
    """The role that a speaker marker names (-1: none), and the line without the marker."""
    m = MARKER.match(line)
    return (ROLE_OF[m[1].lower()], line[m.end() :]) if m else (-1, line)


def emissions(marks: np.ndarray, kinds: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Log chance of each line in the states (role, first) 0-2 and (role, later) 3-5."""
    out = np.empty((len(marks), 6))
    named = marks >= 0
    own = marks[:, None] == np.arange(3)
    out[:, :3] = np.where(named[:, None], np.log(np.where(own, OWN, (1 - OWN) / 2)), np.log(0.05))
    out[:, 3:] = np.where(named, np.log(QUOTED), np.log(1 - 3 * QUOTED))[:, None]
    known = np.maximum(kinds, 0)  # the last bit is the line's place in its turn
    f = np.concatenate([model[:, known & ~1].T, model[:, known | 1].T], axis=1)
    return out + np.where((kinds >= 0)[:, None], f, 0.0)


def transitions(start: np.ndarray, follow: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray]:
    """Log chances of the first state and of each next state."""
    first = np.concatenate([np.log(start), np.full(3, -np.inf)])
    nxt = np.full((6, 6), -np.inf)
    for r in range(3):
        for s in (r, r + 3):
            nxt[s, :3] = np.log(1 - stay) + np.log(follow[r])
            nxt[s, r + 3] = np.log(stay)
    return first, nxt


def viterbi(emit: np.ndarray, first: np.ndarray, nxt: np.ndarray, last: int | None = None) -> np.ndarray:
    """Best states; ties go to the lower state. ``first`` holds the scores of the first line's states."""
    n = len(emit)
    back = np.zeros((n, 6), int)
    score = first + emit[0]
    for i in range(1, n):
        step = score[:, None] + nxt
        back[i] = step.argmax(axis=0)
        score = step[back[i], np.arange(6)] + emit[i]
    path = np.empty(n, int)
    path[-1] = int(score.argmax()) if last is None else last
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def chain_matrix(emit: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Best score from the state before the lines to the state of the last one."""
    m = nxt + emit[0]
    for e in emit[1:]:
        m = (m[:, :, None] + nxt[None]).max(axis=1) + e
    return m


class ChatModel:
    """Counts of known turns, smoothed by one: start of conversations, next role, line classes by role, line lengths."""

    def __init__(self, start=None, follow=None, kinds=None, stay: float = 0.6):
        norm = lambda x: x / x.sum(axis=-1, keepdims=True)
        self.start = norm(np.ones(3) if start is None else start + 1.0)
        self.follow = norm(np.ones((3, 3)) if follow is None else follow + 1.0)
        self.kinds = np.log(norm(np.ones((3, N_FEATURES)) if kinds is None else kinds + 1.0))
        self.stay = min(max(stay, 0.05), 0.95)
        self.first, self.next = transitions(self.start, self.follow, self.stay)


def role_code(role: Column) -> Column:
    """0 to 2 for a known role name, else null."""
    out = F.lit(None).cast("int")
    for name, i in ROLE_OF.items():
        out = F.when(F.lower(F.trim(role)) == name, i).otherwise(out)
    return out


def _line_rows(texts) -> list[list[tuple[int, int]]]:
    """(marker, class) of each line of a row; inline markers only where the row begins."""
    out = []
    for text in texts:
        rows = []
        for place, line in enumerate((text or "").split("\n")):
            mark, body = split_marker(line) if place == 0 else (-1, line)
            rows.append((mark, line_feature(body, place)))
        out.append(rows)
    return out


#: Place of a row: conversation, whether the turn has a number, the number, and the row's own.
PLACE = ["conv", "numbered", "turn", "tie"]


def _compact(batches):
    """(place, role code, text) to (place, mark, told, kinds): ``told`` where the code is the mark."""
    for batch in batches:
        rows = _line_rows(batch.column(5).to_pylist())
        marks = [r[0][0] if c is None else c for r, c in zip(rows, batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(marks, pa.int32()), batch.column(4).is_valid(), pa.array([[k for _, k in r] for r in rows], pa.list_(pa.int32()))], names=[*PLACE, "mark", "told", "kinds"])


def fit(rows: DataFrame) -> ChatModel:
    """Counts over rows (conv, numbered, turn, mark, kinds) of a known mark: a next role is that of the next turn number.

    Repeated rows of a turn count once for each role in starts and successions.
    """
    known = rows.where("mark >= 0")
    start, follow, kinds = np.zeros(3), np.zeros((3, 3)), np.zeros((3, N_FEATURES))
    turns = known.where("numbered = 1").select("conv", "turn", "mark").distinct()
    pairs = turns.join(turns.select("conv", (F.col("turn") - 1).alias("turn"), F.col("mark").alias("next")), ["conv", "turn"])
    for a, b, n in pairs.groupBy("mark", "next").count().collect():
        follow[a, b] = n
    for a, n in turns.where("turn = 0").groupBy("mark").count().collect():
        start[a] = n
    lines = known.select("mark", F.explode("kinds").alias("kind")).groupBy("mark", "kind").count().collect()
    for a, b, n in lines:
        kinds[a, b] = n
    total, turns = kinds.sum(), known.count()
    return ChatModel(start, follow, kinds, 1 - turns / total if total else 0.6)


def _segments(table: pa.Table, model: ChatModel):
    """Conversations of one partition in order: (conv, rows, emissions, row of each line)."""
    table = table.sort_by([(c, "ascending") for c in PLACE])
    conv = np.array(table.column("conv").to_pylist(), object)
    marks, told, kinds = table.column("mark").to_numpy(), table.column("told").to_numpy(), table.column("kinds").to_pylist()
    for rows in np.split(np.arange(len(conv)), np.flatnonzero(conv[1:] != conv[:-1]) + 1):
        if not len(rows):
            continue
        row = np.repeat(rows, [len(kinds[i]) for i in rows])
        opens = np.concatenate([[True], row[1:] != row[:-1]])
        emit = emissions(np.where(opens, marks[row], -1), np.array([k for i in rows for k in kinds[i]], int), model.kinds)
        emit[opens, 3:] = -np.inf  # a row is one turn
        emit[~opens, :3] = -np.inf
        emit[:, :3][(opens & told[row])[:, None] & (marks[row][:, None] != np.arange(3))] = -np.inf  # a known role stays
        yield table, conv[rows[0]], rows, emit, row


def _borders(model: ChatModel):
    def run(table: pa.Table) -> pa.Table:
        own = list(_segments(table, model))
        ends = [own[0], own[-1]]
        mats = [chain_matrix(s[3], model.next).tobytes() for s in ends]
        return pa.table(
            {
                "part": table.column("part").slice(0, 1),
                "head": pa.array([ends[0][1]], pa.string()),
                "tail": pa.array([ends[1][1]], pa.string()),
                "one": pa.array([len(own) == 1]),
                "head_matrix": pa.array([mats[0]], pa.binary()),
                "tail_matrix": pa.array([mats[1]], pa.binary()),
                "tail_start": pa.array([_opening(ends[1][3], model).tobytes()], pa.binary()),
            }
        )

    return run


def _opening(emit: np.ndarray, model: ChatModel) -> np.ndarray:
    """Best score of each last state for lines that begin their conversation."""
    score = model.first + emit[0]
    for e in emit[1:]:
        score = (score[:, None] + model.next).max(axis=0) + e
    return score


def border_states(parts: list) -> dict[int, tuple[int | None, int | None]]:
    """State before the first conversation's lines, and forced last state of the last one's, for each partition."""
    out: dict[int, tuple[int | None, int | None]] = {p.part: (None, None) for p in parts}
    i = 0
    while i < len(parts):
        j = i  # parts i to j share one conversation that begins in i
        while j + 1 < len(parts) and parts[j].tail == parts[j + 1].head and (j == i or parts[j].one):
            j += 1
        if j > i:
            scores, backs = [np.frombuffer(parts[i].tail_start)], []
            for p in parts[i + 1 : j + 1]:
                step = scores[-1][:, None] + np.frombuffer(p.head_matrix).reshape(6, 6)
                backs.append(step.argmax(axis=0))
                scores.append(step.max(axis=0))
            state = int(scores[-1].argmax())
            for p, q, back in reversed(list(zip(parts[i:j], parts[i + 1 : j + 1], backs, strict=True))):
                before = int(back[state])
                out[q.part] = (before, out[q.part][1])
                out[p.part] = (out[p.part][0], before)
                state = before
        i = max(j, i + 1) if j > i else i + 1
    return out


def _decode(model: ChatModel, borders):
    def run(table: pa.Table) -> pa.Table:
        before, last = borders.value[table.column("part")[0].as_py()]
        own, roles = list(_segments(table, model)), np.zeros(table.num_rows, int)
        for i, (_, _, _, emit, row) in enumerate(own):
            first = model.next[before] if i == 0 and before is not None else model.first
            path = viterbi(emit, first, model.next, last if i == len(own) - 1 else None)
            roles[row] = path % 3
        done = own[0][0]
        return pa.table({"tie": done.column("tie"), "found": pa.array(roles, pa.int32())})

    return run


def render(role: Column, text: Column) -> Column:
    """Canonical turn: the role between marks, the text without a leading speaker marker, an end mark."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)" + MARKER.pattern, "")
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n<|end|>\n"))


def format_conversations(df: DataFrame, conv: str, turn: str, role: str | None, text: str, model: ChatModel | None = None) -> DataFrame:
    """``record`` (the row as it was), ``found_role`` and ``rendered`` of every row of a table of turns.

    The role column, if there is one, decides where it names a known speaker; else a marker at the text's start is
    evidence, and the role is recovered from it, the lines and the neighbours. Without a ``model`` one is fitted on the
    table's known roles and markers. Rows of a conversation are chained by turn, those without a number first, ties and
    repeated rows in the order of the input; rows of a null conversation are one chain of their own; a null text is
    empty. No row is dropped. Columns of any name may be present. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows, compact = _placed(df, conv, turn, role, text)
    model = model or fit(compact)
    borders = compact.groupBy("part").applyInArrow(_borders(model), "part int, head string, tail string, one boolean, head_matrix binary, tail_matrix binary, tail_start binary")
    states = spark.sparkContext.broadcast(border_states(sorted(borders.collect(), key=lambda p: p.part)))  # under 1 kB for RANGE_ROWS rows
    found = compact.groupBy("part").applyInArrow(_decode(model, states), "tie long, found int")
    name = F.array(*[F.lit(r) for r in ROLES])[F.col("found")]
    return rows.join(found, "tie").select("record", name.alias("found_role"), render(name, F.col(f"record.`{text}`")).alias("rendered"))


def fit_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> ChatModel:
    """Model of the rows of a table of turns whose role is known or marked."""
    return fit(_placed(df, conv, turn, role, text)[1])


def _placed(df: DataFrame, conv: str, turn: str, role: str | None, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their number, and their lines in ranges of (conversation, turn)."""
    rows = scratch.materialize(
        df.select(
            F.struct(*[df[c] for c in df.columns]).alias("record"),
            F.coalesce(F.concat(F.lit("c"), df[conv].cast("string")), F.lit("")).alias("conv"),
            df[turn].isNotNull().cast("int").alias("numbered"),
            F.coalesce(df[turn].cast("long"), F.lit(0)).alias("turn"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "turns",
    )
    told = role_code(F.col(f"record.`{role}`")) if role else F.lit(None).cast("int")
    lines = rows.select(*PLACE, told.alias("code"), F.col(f"record.`{text}`").alias("text")).mapInArrow(_compact, "conv string, numbered int, turn long, tie long, mark int, told boolean, kinds array<int>")
    n = rows.count()
    n = max(1, n // RANGE_ROWS, min(df.sparkSession.sparkContext.defaultParallelism, n // 2000))
    return rows, scratch.materialize(lines.repartitionByRange(n, *PLACE).withColumn("part", F.spark_partition_id()), "lines")


def parse_transcripts(df: DataFrame, key: str, text: str, model: ChatModel | None = None) -> DataFrame:
    """``key``, ``turn``, ``role``, ``rendered`` of the turns in raw transcripts, one text a row.

    Every line may begin a turn; lines without a marker continue one or not as the model finds best. Null and empty
    texts have no turns; repeated rows are parsed alike.
    """
    model = model or ChatModel(start=np.array([2, 6, 1]), follow=np.array([[0, 9, 1], [0, 1, 18], [0, 18, 1]]))

    def run(batches):
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or not text.strip():
                    continue
                parsed = [split_marker(CLOSING.sub("", x)) for x in text.split("\n")]
                marks = np.array([m for m, _ in parsed])
                path = viterbi(emissions(marks, np.array([line_feature(b, 0) for _, b in parsed]), model.kinds), model.first, model.next)
                turns: list[tuple[int, list[str]]] = []
                for state, (_, body) in zip(path, parsed, strict=True):
                    if state < 3 or not turns:
                        turns.append((int(state) % 3, []))
                    turns[-1][1].append(body)
                out += [(k, i, ROLES[r], f"<|{ROLES[r]}|>\n" + "\n".join(b).strip() + "\n<|end|>\n") for i, (r, b) in enumerate(turns)]
            ks, ts, rs, xs = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch({key: pa.array(ks, batch.column(0).type), "turn": pa.array(ts, pa.int64()), "role": pa.array(rs, pa.string()), "rendered": pa.array(xs, pa.string())})

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, turn long, role string, rendered string")


def held_out(conv: Column) -> Column:
    """Whether a conversation's roles are not learnt from."""
    return F.crc32(F.coalesce(conv.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's role from its lines and its neighbours alone: roles are read only where the model is fitted."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    model = fit_turns(turns.where(~held_out(F.col("conv_id"))), "conv_id", "turn", "role", "text")
    out = format_conversations(turns.select("conv_id", "turn", "text"), "conv_id", "turn", None, "text", model)
    return out.select("record.conv_id", "record.turn", held_out(F.col("record.conv_id")).alias("held_out"), F.col("found_role").alias("role"), F.sha2("rendered", 256).alias("rendered_sha256"))
