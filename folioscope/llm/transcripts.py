"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are a role and whether a line opens a turn or goes on with it. Line features (a speaker
marker, an empty line before, a question, ...) are emitted independently given the state. The model is
estimated by counting over lines whose roles are known. Viterbi runs over blocks of lines: a block's
best scores between any two end states form a small matrix, the matrices of a transcript are folded
in order, and with the end states fixed each block is decoded on its own. So a transcript of any
length is decoded exactly without being in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import durable

ROLES = ("system", "user", "assistant")
STATES = tuple((role, opens) for role in ROLES for opens in (True, False))
#: Lines of a block.
BLOCK = 512
#: Lines that a group of blocks has about, and groups at least.
GROUP_LINES, LEAST_GROUPS = 8 * BLOCK, 64

#: Words before a colon (or in brackets, or after ###) that mark a speaker, and whose they are.
MARKERS = {
    "system": "system", "instruction": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "you": "user", "me": "user", "customer": "user", "q": "user", "question": "user", "prompt": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "agent": "assistant", "gpt": "assistant", "a": "assistant", "answer": "assistant",
}
_MARKER = re.compile(r"^\s*(?:\*\*|##+\s*|\[|<\|?)?\s*([A-Za-z]{1,12})\s*(?:\*\*\s*:|:\s*\*\*|\|?>|\]\s*:?|:)\s*")
_BARE = re.compile(r"^\s*##+\s*([A-Za-z]{1,12})\s*$")
#: Kinds of marker (none, one per role, a name that isn't known), then yes/no features.
KINDS = 5
FEATURES = ("first line", "short", "long", "ends as a question", "list or code", "upper-case start", "after an empty line")


def marker(line: str) -> tuple[int, int]:
    """(kind, length) of the speaker marker at the line's start; kind 0 is none."""
    found = _MARKER.match(line) or _BARE.match(line)
    if not found:
        return 0, 0
    role = MARKERS.get(found[1].lower())
    if role is None:
        return (KINDS - 1, 0) if len(found[1]) > 1 and found[1][0].isupper() and len(line) - found.end() > 0 else (0, 0)
    return 1 + ROLES.index(role), found.end()


def features(line: str, first: bool, after_empty: bool) -> tuple[int, int]:
    """(marker kind, bits of FEATURES) of one line."""
    kind, skip = marker(line)
    body = line[skip:].strip()
    flags = (first, len(body) < 40, len(body) > 200, body.endswith("?"), body[:2] in ("- ", "* ", "``") or body[:1].isdigit(), body[:1].isupper(), after_empty)
    return kind, sum(1 << k for k, flag in enumerate(flags) if flag)


@dataclass
class LineModel:
    """Log probabilities: start by state, transitions, marker kinds by state, features by state."""

    start: np.ndarray
    move: np.ndarray
    kinds: np.ndarray
    flags: np.ndarray

    def emission(self, kind: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Log probability of each line's features under each state."""
        set_ = (bits[:, None] >> np.arange(len(FEATURES))) & 1
        return self.kinds[:, kind].T + set_ @ (self.flags[:, :, 1] - self.flags[:, :, 0]).T + self.flags[:, :, 0].sum(axis=1)


_LINE_FIELDS = "at int, line string, kind int, skip int, bits int, truth int"


def lines(transcripts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(conv_id, at, line, kind, skip, bits, truth): every line that isn't blank, with its features; truth is -1.

    A null or blank transcript has no lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                empty, at = False, 0
                for line in (text or "").splitlines():
                    if not line.strip():
                        empty = True
                        continue
                    kind, bits = features(line, at == 0, empty)
                    owner.append(k)
                    out.append((at, line, kind, marker(line)[1], bits, -1))
                    empty, at = False, at + 1
            yield _line_batch(batch.column(0).take(pa.array(owner, pa.int64())), out)

    kind = transcripts.schema[id_column].dataType.simpleString()
    return transcripts.select(id_column, text_column).mapInArrow(run, f"conv_id {kind}, {_LINE_FIELDS}")


def _line_batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _LINE_FIELDS.split(", ")]
    kinds = [pa.string() if n == "line" else pa.int32() for n in names]
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([ids, *columns], ["conv_id", *names])


def _before(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows ahead of each in its group.

    In two steps, so that only one row per bucket of a large group comes together.
    """
    dealt = rows.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = own["_bucket"].eqNullSafe(offsets["_b"])
    for k in keys:
        same = same & own[k].eqNullSafe(offsets[f"_{k}"])
    return own.join(offsets, same).withColumn("before", F.col("_inside") + F.col("_offset")).drop("_bucket", "_value", "_b", "_offset", "_inside", *(f"_{k}" for k in keys))


def marked_lines(conversations: DataFrame, unmarked: int) -> DataFrame:
    """Lines of the transcripts that conversations (conv_id, turn, role, text) would be written as, with the true states.

    Each conversation has one of four marker styles, by a hash of its id; ``unmarked`` sixteenths of the
    turns have no marker. Turns come by number, then role and text; null texts have no lines. Lines of
    turns without a known role have truth -1 and no marker.
    """
    role = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.lower("role"))
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(4))
    names = {"system": ("System", "SYSTEM", "Context", "system"), "user": ("User", "Human", "Question", "user"), "assistant": ("Assistant", "AI", "Answer", "assistant")}
    forms = ("{}: ", "### {}: ", "**{}:** ", "[{}] ")
    label = F.element_at(
        F.array(*(F.array(*(F.lit(form.format(names[r][k])) for k, form in enumerate(forms))) for r in ROLES)), F.greatest("_role", F.lit(1)).cast("int")
    )[style.cast("int")]
    bare = (F.pmod(F.xxhash64(F.lit("bare"), "conv_id", "turn"), F.lit(16)) < unmarked) | (F.col("_role") == 0)
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "\\R"), lambda x: F.trim(x) != "")
    given = conversations.select("conv_id", "turn", F.coalesce(role, F.lit(0)).cast("int").alias("_role"), parts.alias("_parts"), F.xxhash64("text").alias("_tie"))
    numbered = _before(given, ["conv_id"], (F.coalesce("turn", F.lit(0)) / BLOCK).cast("long"), ["turn", "_role", "_tie"], F.size("_parts"))
    each = numbered.select("conv_id", "before", "_role", F.when(bare, "").otherwise(label).alias("_label"), F.posexplode("_parts").alias("_k", "_line"))
    truth = F.when(F.col("_role") > 0, (F.col("_role") - 1) * 2 + (F.col("_k") > 0).cast("int")).otherwise(-1)
    plain = each.select("conv_id", (F.col("before") + F.col("_k")).cast("int").alias("at"), F.concat(F.when(F.col("_k") == 0, F.col("_label")).otherwise(""), "_line").alias("line"), truth.cast("int").alias("truth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, line, true in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                kind, bits = features(line, at == 0, False)
                rows.append((at, line, kind, marker(line)[1], bits, true))
            yield _line_batch(batch.column(0), rows)

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"conv_id {kind}, {_LINE_FIELDS}")


def estimate(labelled: DataFrame) -> LineModel:
    """Count the model over lines (conv_id, at, kind, bits, state); every count starts at one half, so unseen events stay possible.

    Only sums come to the driver: states squared, states times kinds, states times features.
    """
    n = len(STATES)
    start, move = np.full(n, 0.5), np.full((n, n), 0.5)
    kinds, flags = np.full((n, KINDS), 0.5), np.full((n, len(FEATURES), 2), 0.5)
    after = F.lag("state").over(Window.partitionBy("conv_id", (F.col("at") / BLOCK).cast("long")).orderBy("at"))
    for r in labelled.withColumn("before", after).groupBy("before", "state", (F.col("at") == 0).alias("head")).count().collect():
        if r["head"]:
            start[r["state"]] += r["count"]
        elif r["before"] is not None:
            move[r["before"], r["state"]] += r["count"]
    for r in labelled.groupBy("state", "kind").count().collect():
        kinds[r["state"], r["kind"]] += r["count"]
    sums = [F.sum(F.shiftright("bits", k).bitwiseAND(1)).alias(f"f{k}") for k in range(len(FEATURES))]
    for r in labelled.groupBy("state").agg(F.count("*").alias("n"), *sums).collect():
        for k in range(len(FEATURES)):
            flags[r["state"], k, 1] += r[f"f{k}"]
            flags[r["state"], k, 0] += r["n"] - r[f"f{k}"]
    norm = lambda a: np.log(a / a.sum(axis=-1, keepdims=True))
    return LineModel(norm(start), norm(move), norm(kinds), norm(flags))


def _path(model: LineModel, scores: np.ndarray, entry: np.ndarray, last: int | None) -> np.ndarray:
    """Best states of a run of lines, given log scores of the states at its first line (emission left out) and maybe the last state."""
    best, back = entry + scores[0], np.zeros(scores.shape, np.int64)
    for k in range(1, len(scores)):
        through = best[:, None] + model.move
        back[k] = through.argmax(axis=0)
        best = through.max(axis=0) + scores[k]
    states = np.zeros(len(scores), np.int64)
    states[-1] = best.argmax() if last is None else last
    for k in range(len(scores) - 1, 0, -1):
        states[k - 1] = back[k, states[k]]
    return states


def decode(rows: DataFrame, model: LineModel) -> DataFrame:
    """``rows`` of ``lines`` with the Viterbi ``state`` of every line. ``at`` counts from 0 without gaps in each transcript."""
    told = rows.sparkSession.sparkContext.broadcast((model.start, model.move, model.kinds, model.flags))
    blocked = rows.withColumn("block", (F.col("at") / BLOCK).cast("int"))
    n = len(STATES)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def ordered(table: pa.Table) -> Iterator[pa.Table]:
        """The blocks of a group of rows, each in line order."""
        table = table.sort_by([("conv_id", "ascending"), ("block", "ascending"), ("at", "ascending")]).combine_chunks()
        head = np.flatnonzero(np.asarray(table["at"]) % BLOCK == 0)
        for a, b in zip(head, [*head[1:], table.num_rows], strict=True):
            yield table.slice(a, b - a)

    def matrices(table: pa.Table) -> pa.Table:
        model = LineModel(*told.value)
        ids, blocks, out = [], [], []
        for own in ordered(table):
            scores = model.emission(np.asarray(own["kind"]), np.asarray(own["bits"]))
            best = np.where(np.eye(n, dtype=bool), 0.0, -np.inf) + scores[0]
            for k in range(1, len(scores)):
                best = (best[:, :, None] + model.move[None]).max(axis=1) + scores[k]
            ids.append(own["conv_id"][0].as_py())
            blocks.append(own["block"][0].as_py())
            out.append(best.ravel().tolist())
        return pa.table({"conv_id": pa.array(ids, table.schema.field("conv_id").type), "block": pa.array(blocks, pa.int32()), "best": pa.array(out, pa.list_(pa.float64()))})

    def ends(table: pa.Table) -> pa.Table:
        """For each block of a group's transcripts the last state of the best path, and the scores at its first line."""
        model = LineModel(*told.value)
        table = table.sort_by([("conv_id", "ascending"), ("block", "ascending")]).combine_chunks()
        block = np.asarray(table["block"])
        best = np.asarray(table["best"].combine_chunks().flatten() if isinstance(table["best"], pa.ChunkedArray) else table["best"].flatten()).reshape(-1, n, n)
        last, entry = np.zeros(len(block), np.int32), np.zeros((len(block), n))
        head = np.flatnonzero(block == 0)
        for a, b in zip(head, [*head[1:], len(block)], strict=True):
            begin, chosen = model.start, []
            for k in range(a, b):
                entry[k] = begin
                through = begin[:, None] + best[k]
                chosen.append(through.argmax(axis=0))
                score = through.max(axis=0)
                begin = (score[:, None] + model.move).max(axis=0)
            state = int(score.argmax())
            for k in range(b - 1, a - 1, -1):
                last[k] = state
                if k > a:
                    first = chosen[k - a][state]
                    previous = entry_scores(entry[k - 1], best[k - 1])
                    state = int((previous + model.move[:, first]).argmax())
        return pa.table({"conv_id": table["conv_id"], "block": pa.array(block, pa.int32()), "last": pa.array(last, pa.int32()), "entry": pa.array(entry.tolist(), pa.list_(pa.float64()))})

    def entry_scores(entry: np.ndarray, best: np.ndarray) -> np.ndarray:
        return (entry[:, None] + best).max(axis=0)

    def states(left: pa.Table, right: pa.Table) -> pa.Table:
        model = LineModel(*told.value)
        fixed = {(c, b): (s, e) for c, b, s, e in zip(*(right[x].to_pylist() for x in ("conv_id", "block", "last", "entry")), strict=True)}
        parts = []
        for own in ordered(left):
            last, entry = fixed[own["conv_id"][0].as_py(), own["block"][0].as_py()]
            path = _path(model, model.emission(np.asarray(own["kind"]), np.asarray(own["bits"])), np.array(entry), last)
            parts.append(own.drop_columns(["block", "group"]).append_column("state", pa.array(path, pa.int32())))
        return pa.concat_tables(parts) if parts else left.drop_columns(["block", "group"]).append_column("state", pa.array([], pa.int32()))

    # Many short transcripts share a group; a long one is dealt out by block. The number of groups follows the lines.
    groups = F.lit(max(LEAST_GROUPS, rows.count() // GROUP_LINES))
    spread = F.pmod(F.xxhash64("conv_id", "block"), groups)
    blocked = blocked.withColumn("group", spread)
    each = blocked.groupBy("group").applyInArrow(matrices, f"conv_id {kind}, block int, best array<double>")
    by_conv = each.withColumn("group", F.pmod(F.xxhash64("conv_id"), groups))
    fixed = by_conv.groupBy("group").applyInArrow(ends, f"conv_id {kind}, block int, last int, entry array<double>")
    fixed = durable(fixed.withColumn("group", spread))
    return blocked.groupBy("group").cogroup(fixed.groupBy("group")).applyInArrow(states, f"conv_id {kind}, {_LINE_FIELDS}, state int")


def turns(decoded: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, chat, n_lines, n_right): the recovered turns, their lines joined without markers.

    ``chat`` is the canonical form. ``n_right`` counts lines whose true role is known and met.
    """
    opens = ((F.col("state") % 2 == 0) | (F.col("at") == 0)).cast("int")
    numbered = _before(decoded.withColumn("_opens", opens), ["conv_id"], (F.col("at") / BLOCK).cast("long"), ["at"], F.col("_opens"))
    role = F.element_at(F.array(*(F.lit(r) for r in ROLES)), (F.col("state") / 2).cast("int") + 1)
    right = (F.col("truth") >= 0) & ((F.col("truth") / 2).cast("int") == (F.col("state") / 2).cast("int"))
    each = numbered.select(
        "conv_id", "at", (F.col("before") + F.col("_opens") - 1).cast("int").alias("turn"), role.alias("role"),
        F.trim(F.expr("substring(line, skip + 1)")).alias("body"), right.cast("int").alias("right"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n")
    joined = each.groupBy("conv_id", "turn").agg(F.min_by("role", "at").alias("role"), text.alias("text"), F.count("*").alias("n_lines"), F.sum("right").alias("n_right"))
    chat = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    return joined.select("conv_id", "turn", "role", "text", chat.alias("chat"), "n_lines", "n_right")


def parse(transcripts: DataFrame, model: LineModel, id_column: str = "conv_id", text_column: str = "text") -> DataFrame:
    """The canonical turns of raw transcripts, one text each; see ``turns``. Transcripts of one id are one after the other only by accident: ids must be unique."""
    return turns(decode(durable(lines(transcripts, id_column, text_column)), model))


def recovered(conversations: DataFrame, unmarked: int) -> DataFrame:
    """Write conversations as transcripts with missing markers, learn the model from four fifths of them, recover the turns of all.

    See ``turns`` for the columns. Null ids are one conversation; a conversation without any line gives no row.
    """
    rows = durable(marked_lines(conversations, unmarked))
    learn = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0, F.lit(True))
    model = estimate(rows.where(learn & (F.col("truth") >= 0)).withColumn("state", F.col("truth")))
    return turns(decode(rows, model))
