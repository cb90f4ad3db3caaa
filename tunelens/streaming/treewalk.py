"""Many trees over a whole replay: each tree walks through the rows of a block in a task of its own.

A tree needs its batches one after another but no other tree. The rows of a batch are packed into one, compressed, and the
batches of a block are dealt to every tree. A task takes them in order for its tree: it routes the rows of a batch, judges
them by the leaves as they are, adds them to the sums, and splits the leaves that are due, as :meth:`TreeLearner.step`
would. So leaves have their numbers at once, and a tree may draw attributes by the number of a leaf; and no leaf has to note
what it predicts before each batch.

A task holds one batch and one tree. Of a block are written: the counts by label and prediction, or, for an ensemble, the
place of each row's leaf and the shares of the leaves, which are put together batch by batch; the leaves as they are after
the block; and the splits, which alone reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.session import configured, dropped, scratch_path, stored
from tunelens.sources.replay import Replay
from tunelens.streaming import treereplay as R
from tunelens.streaming import trees as T
from tunelens.streaming.walks import CHUNK_ROWS, WALK_ROWS

#: Trees that grow apart, from which on each walks through its rows alone; fewer leave cores idle.
MANY = 8

_COUNT, _STATE, _SPLIT, _VOTE = range(4)
_WALKED = """what int, m int, leaf int, batch bigint, label int, prediction int, n bigint, part array<double>,
    right_majority double, right_bayes double, attr int, kind string, value double, branches array<double>, places binary,
    labels binary"""
#: Packed batches, or states of leaves, that a worker is sent together.
SENT = 8
#: Columns of a leaf's state as they travel with the batches.
_KEPT = "m", "leaf", "part", "right_majority", "right_bayes"


def _draws(learner: T.TreeLearner) -> bool:
    return any(t.options.growth and t.subset is not None and t.subset < len(t.allowed) for t in learner.trees.values())


def in_tasks(learner, replay: Replay) -> bool:
    """Whether the trees of a replay walk alone: there are many, or their leaves are numbered batch by batch."""
    if not R.in_blocks(learner) or replay.chunk > CHUNK_ROWS:
        return False
    grow = {k for k in R._leaders(learner) if list(learner.trees.values())[k].options.growth}
    return _draws(learner) or len(grow) >= MANY


class _Walk:
    """One tree on its way through the batches of a block."""

    def __init__(self, learner: T.TreeLearner, m: int, pivots: list[float]):
        self.learner, self.m, self.pivots = learner, m, pivots
        self.tree = list(learner.trees.values())[m]
        self.judge = R.Judge(learner)
        self._settle(self._leaves(self.tree.leaves()))
        self.right = np.zeros((len(self.leaves.at), 2))  # rows that the majority, and the Bayes model, were right about

    def _leaves(self, at: list[int]) -> R._Leaves:
        return R._Leaves(self.learner, np.full(len(at), self.m), np.array(at, dtype=np.int64))

    def _settle(self, leaves: R._Leaves) -> None:
        self.leaves, self.routes = leaves, R.Routes(self.tree, {})
        self.place = np.full(len(self.tree.nodes), -1)
        self.place[leaves.at] = np.arange(len(leaves.at))

    def load(self, leaf: np.ndarray, part: np.ndarray, right: np.ndarray) -> None:
        own = self.place[leaf]
        self.leaves.load(own, part)
        self.right[own] = right

    def step(self, batch: int, table) -> Iterator[dict]:
        """Rows of one batch: judged by the tree as it is, then learnt."""
        learner, leaves = self.learner, self.leaves
        x, null = R._matrix(table, len(learner.features))
        label = R._ints(table, "label")
        own = self.place[self.routes.leaf(x, np.zeros(len(x), dtype=np.int64))]
        met, at = np.unique(own, return_inverse=True)
        number = np.full(len(met), batch)
        notes = leaves.notes(met, number)
        if learner.votes:
            first = {"labels": label.astype(np.int32).tobytes()} if not self.m else {}
            yield {"what": _VOTE, "m": self.m, "batch": batch, "places": at.astype(np.int32).tobytes(),
                   "part": notes["shares"].ravel(), **first}
        else:
            bayes = self.judge.bayes(notes.get("model"), notes.get("has_model"), at, x, null)
            right = self.right[met]
            trusted = notes["sure"] | (notes["may"] & (right[:, 1] > right[:, 0]))
            majority = notes["majority"][at]
            guess = np.where(trusted[at], bayes, majority)
            pairs, n = np.unique(label.astype(np.int64) * learner.classes + guess, return_counts=True)
            for pair, k in zip(pairs.tolist(), n.tolist()):
                y, g = divmod(pair, learner.classes)
                yield {"what": _COUNT, "m": self.m, "batch": batch, "label": y, "prediction": g, "n": k}
            for i, kind in enumerate((majority, bayes)):
                self.right[met, i] += np.bincount(at, kind == label, len(met))
        y = learner.targets(label, self.m)
        order = np.lexsort((y, own))
        key = np.column_stack([own[order], y[order]])
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        w = learner.weights_of(table, self.m)[order]
        part = R._sums(learner.layout, x[order], null[order], w, starts, self.pivots)
        seen = part[:, 0] > 0
        key, part = key[starts][seen], part[seen]
        learner.layout.absorb_all(leaves.sums, (key[:, 0], key[:, 1]), part, self.pivots)
        won = sorted(leaves.close(met, number), key=lambda s: s["leaf"])
        born: list[int] = []
        for s in won:
            born += self.tree.split(
                int(s["leaf"]), s["attr"], s["kind"], s["value"], s["branches"].reshape(-1, learner.layout.classes).tolist())
            yield s | {"what": _SPLIT}
        if won:
            kept = ~leaves.split
            self.right = np.concatenate([self.right[kept], np.zeros((len(born), 2))])
            self._settle(leaves.joined(kept, self._leaves(born)))

    def states(self) -> Iterator[dict]:
        own = np.arange(len(self.leaves.at))
        for leaf, part, right in zip(self.leaves.at.tolist(), self.leaves.states(own)["part"], self.right.tolist()):
            yield {"what": _STATE, "m": self.m, "leaf": leaf, "part": part, "right_majority": right[0], "right_bayes": right[1]}


def _pack(batches: Iterator) -> Iterator:
    """The rows of each batch, which come together and in order, as one compressed Arrow stream."""
    import pyarrow as pa

    at, held = None, []

    def closed():
        table = pa.Table.from_batches(held).drop_columns(["batch", "row"]).combine_chunks()
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([out.getvalue().to_pybytes()])], names=["batch", "rows"])

    for table in batches:
        if not table.num_rows:
            continue
        batch = R._ints(table, "batch")
        starts = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]])
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)]):
            if held and batch[i] != at:
                yield closed()
                held = []
            at = int(batch[i])
            held.append(table.slice(i, j - i))
    if held:
        yield closed()


def _walk(learner: T.TreeLearner, pivots: list[float]):
    """Trees through the batches of a block, which come sorted by tree and batch after the states of a tree's leaves."""
    width = len(learner.features) + 1 + learner.layout.classes * learner.layout.width

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        floats = pa.list_(pa.float64())
        types = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
        named = [c.split() for c in _WALKED.split(",")]
        schema = pa.schema([(name, types.get(t, floats)) for name, t in named])

        def packed(rows: list[dict]):
            return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

        def left(own: _Walk):
            rows = []
            for r in own.states():
                rows.append(r)
                if len(rows) == 1000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

        own: _Walk | None = None
        for table in batches:
            m, batch = R._ints(table, "m"), R._ints(table, "batch")
            for i in range(len(m)):
                if own is None or own.m != m[i]:
                    if own is not None:
                        yield from left(own)
                    own = _Walk(learner, int(m[i]), pivots)
                if batch[i] < 0:
                    leaf, part, *right = (table.column(c)[i].as_py() for c in _KEPT[1:])
                    own.load(np.array([leaf]), np.array(part).reshape(1, width), np.array([right]))
                    continue
                with pa.ipc.open_stream(table.column("rows")[i].as_buffer()) as reader:
                    rows = reader.read_all().combine_chunks().to_batches()[0]
                yield packed(list(own.step(int(batch[i]), rows)))
        if own is not None:
            yield from left(own)

    return run


def _count_votes(learner: T.TreeLearner):
    """The shares that the trees gave the rows of a batch: counts by label and vote."""
    classes = learner.layout.classes

    def run(key, rows):
        import pyarrow as pa

        rows = rows.sort_by("m")
        places = [np.frombuffer(p, np.int32) for p in rows.column("places").to_pylist()]
        shares = [np.reshape(s, (-1, classes)) for s in rows.column("part").to_pylist()]
        label = np.frombuffer(rows.column("labels")[0].as_py(), np.int32)
        vote = np.argmax(learner.votes_of([s[p] for s, p in zip(shares, places)]), axis=1)
        pairs, n = np.unique(label.astype(np.int64) * classes + vote, return_counts=True)
        columns = [np.full(len(n), key[0].as_py()), (pairs // classes).astype(np.int32), (pairs % classes).astype(np.int32), n]
        return pa.table([pa.array(c) for c in columns], names=["batch", "label", "prediction", "n"])

    return run


def _walked(learner: T.TreeLearner, batches: DataFrame, states: DataFrame, chosen: list[int], pivots) -> str:
    """Where the chosen trees write what they make of the packed batches of a block. They split in the driver, too."""
    spark, members = batches.sparkSession, list(learner.trees.values())
    path = scratch_path(spark, "walked", learner.home)
    every = batches.withColumn("m", F.explode(F.array(*map(F.lit, chosen))))
    known = states.where(F.col("m").isin(chosen)).select(F.lit(-1).cast("bigint").alias("batch"), *_KEPT)
    place = F.array_position(F.array(*map(F.lit, chosen)), F.col("m")).cast("int") - 1
    dealt = every.unionByName(known, allowMissingColumns=True).repartitionById(len(chosen), place)
    in_turn = dealt.sortWithinPartitions("m", "batch")
    with configured(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(SENT)}):
        in_turn.mapInArrow(_walk(learner, pivots), _WALKED).write.parquet(path)
    won = spark.read.schema(_WALKED).parquet(path).where(F.col("what") == _SPLIT)
    # One row per split that won, in the order that numbers the new leaves.
    for _, m, leaf, *split, branches in sorted(
            tuple(r) for r in won.select("batch", "m", "leaf", "attr", "kind", "value", "branches").collect()):
        members[m].split(leaf, *split, np.reshape(branches, (-1, learner.layout.classes)).tolist())
    return path


def run(learner: T.TreeLearner, replay: Replay) -> DataFrame:
    """(batch, member, label, prediction, n) of every batch; the learner ends as if it had stepped through them."""
    spark = replay.ordered.table.sparkSession
    names, members = list(learner.trees), list(learner.trees.values())
    known = replay.numbered("row", "batch").where("label IS NOT NULL")
    first = known.agg(F.min("batch")).first()[0]
    if first is None:
        return spark.createDataFrame([], f"batch bigint, {learner.row_schema}")
    pivots = learner._pivots(replay.batch(first).where("label IS NOT NULL"))
    features = [F.col(f"`{f.name}`").cast("double").alias(f"f{i}") for i, f in enumerate(learner.features)]
    leader, paths = R._leaders(learner), []
    forks: list[tuple[int, int, int]] = []  # (leader, tree, batch it left its leader at)
    states = learner.leaves(spark).where("sums IS NOT NULL").select(
        "m", "leaf", F.concat(F.array("tried"), F.col("poor").cast("array<double>"), "sums").alias("part"),
        "right_majority", "right_bayes")
    length = max(1, WALK_ROWS // replay.chunk)
    files = max(1, min(len(replay), max(2 * spark.sparkContext.defaultParallelism, replay.rows // R.ROWS_PER_FILE)))
    rows = known.select("batch", "row", F.col("label").cast("int").alias("label"), *learner.drawing(), *features)
    # Batches lie in order, so those of a block are in few files.
    in_turn = rows.repartitionByRange(files, "batch").sortWithinPartitions("batch", "row")
    batches = stored(in_turn.mapInArrow(_pack, "batch bigint, rows binary"), "packed")
    for start in range(first, len(replay), length):
        rows = batches.where((F.col("batch") >= start) & (F.col("batch") < start + length))
        held = {m: R._copied(members[m].nodes) for m in {k for i, k in enumerate(leader) if k != i}}
        block = [_walked(learner, rows, states, [m for m, k in enumerate(leader) if k == m], pivots)]
        # A tree that may not test where its leader might have goes its own way, from this block on.
        apart = [m for m, k in enumerate(leader) if k != m and members[k].depth >= members[m].options.max_depth]
        if apart:
            for m in apart:
                members[m].nodes = R._copied(held[leader[m]])
            own = F.array(*[F.array(*[F.lit(m) for m in apart if leader[m] == k] or [F.lit(-1)]) for k in range(len(members))])
            theirs = states.withColumn("m", F.explode(own[F.col("m")])).where("m >= 0")
            block.append(_walked(learner, rows, theirs, apart, pivots))
            for m in apart:
                forks.append((leader[m], m, start))
                leader[m] = m
        states = spark.read.schema(_WALKED).parquet(*block).where(F.col("what") == _STATE).select(*_KEPT)
        paths += block
    for m, k in enumerate(leader):
        if k != m:
            members[m].nodes = R._copied(members[k].nodes)
    every = F.array(*[F.array(*[F.lit(m) for m, own in enumerate(leader) if own == k] or [F.lit(k)]) for k in range(len(members))])
    _keep_leaves(learner, states, every)
    made = spark.read.schema(_WALKED).parquet(*paths)
    if learner.votes:
        votes = made.where(F.col("what") == _VOTE).select("m", "batch", "places", "part", "labels")
        counts = votes.groupBy("batch").applyInArrow(_count_votes(learner), "batch bigint, label int, prediction int, n bigint")
        return counts.select("batch", F.lit("ensemble").alias("member"), "label", "prediction", "n")
    counts = made.where(F.col("what") == _COUNT).select("m", "batch", "label", "prediction", "n")
    if forks:
        lots = F.broadcast(spark.createDataFrame(forks, "m int, own int, until bigint"))
        earlier = counts.join(lots, "m").where("batch < until").withColumn("m", F.col("own"))
        counts = counts.withColumn("m", F.explode(every[F.col("m")])).unionByName(earlier.select(counts.columns))
    else:
        counts = counts.withColumn("m", F.explode(every[F.col("m")]))
    member = F.element_at(F.array(*map(F.lit, names)), F.col("m") + 1).alias("member")
    return counts.select("batch", member, "label", "prediction", "n")


def _keep_leaves(learner: T.TreeLearner, states: DataFrame, every) -> None:
    """Write the leaves as they are after the last batch, for predictions and further steps."""
    spark, members = states.sparkSession, list(learner.trees.values())
    width = len(learner.features)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, sum(len(t.leaves()) for t in members) // T.LEAVES_PER_TASK))
    rows = states.select(
        "m", "leaf", F.col("part")[0].alias("tried"), "right_majority", "right_bayes",
        F.slice("part", 2, width).cast("array<int>").alias("poor"),
        F.slice("part", width + 2, learner.layout.classes * learner.layout.width).alias("sums"),
        F.lit(None).cast("array<int>").alias("parts"))
    path = scratch_path(spark, "leaves", learner.home)
    as_they_are = T._advance_all(members, learner.layout, learner.pivots, tries=False)
    leaves = rows.repartition(tasks, "m", "leaf").mapInArrow(as_they_are, T.LEAF)
    leaves.withColumn("m", F.explode(every[F.col("m")])).write.parquet(path)
    for old in learner.written[:-1]:
        dropped(spark, old)
    learner.written, learner.fresh = [*learner.written[-1:], path], []
