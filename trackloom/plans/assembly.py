"""Assembly of training data: keypoints of many agents to chunks of named input and label groups, and chunks back to tracks.

A row carries its features in a few array columns. Senses cost one shuffle by frame, everything else one by agent. What is learned
(sizes, scales, bins) is kept in the frame's stages, so that other data are treated alike, and every chunk carries the pose that it
starts from, so that labels or predictions in it can be undone to poses without the data they came from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import agents, motion, pose, sequences
from trackloom.plans.stages import FeatureFrame, Roll, Stage, replay
from trackloom.plans.vectors import VectorBins, VectorSplit, VectorZScore
from trackloom.sources.scratch import stored

RELATIVE = pose.POSE[3:]
VELOCITY = ("forward", "sideways", "turn", *RELATIVE)
ANGLES = [n == "orientation" or n.endswith("_angle") for n in pose.POSE]
SENSES = {"vision": agents.SECTORS, "touch": len(pose.KEYPOINTS) * len(agents.TOUCHED), "wall": len(pose.KEYPOINTS)}
INPUTS = ("velocity_before", "relative_pose", *SENSES)
DISCRETE = ("forward", "sideways", "turn")


def split_pose(column: str = "pose") -> tuple[Column, Column]:
    """Global pose (x, y, heading) and relative pose."""
    return F.slice(column, 1, 3), F.slice(column, 4, len(RELATIVE))


def merge_pose(global_: str, relative: str) -> Column:
    return F.concat(global_, relative)


def feature_rows(tracks: DataFrame, sizes: DataFrame, valid: Column, frame: list[str] = ("t",), agent: str = "agent", t: str = "t", id: str = "id", kp: str = "kp") -> DataFrame:
    """The valid rows with session, pose, relative_pose, velocity (NULL at a session's end) and the SENSES, an array each.

    ``frame``: the columns that name a moment of one arena, t among them. ``sizes`` has one row per individual. Sessions end at
    invalid rows, gaps, and where isstart is true or the individual changes.
    """
    if "isstart" not in tracks.columns:
        tracks = sequences.start_flags(tracks, agent, t, id)
    marked = tracks.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    sensed = agents.senses(marked.where("_valid"), list(frame), agent, kp, keep=[id, "isstart", kp])
    walled = agents.wall_touch(sensed, kp)
    posed = pose.pose_features(walled, sizes, id, kp)
    rows = posed.withColumn("pose", F.array(*pose.POSE)).drop(*pose.POSE)
    rows = sequences.session_rows(rows, F.lit(True), agent, t)
    rows = motion.pose_velocity(rows, "pose", ANGLES, [agent, "session"], t)
    return rows.withColumn("relative_pose", split_pose()[1])


@dataclass(frozen=True)
class Dataset:
    """Chunks of training data and what made them.

    chunks: agent, session, chunk_start, id, start (pose of the first row) and rows, an array of (pos, inputs, labels) structs.
    frame: the rows before chunking, with the fitted stages. inputs, labels: the groups in order, with their widths.
    """

    chunks: DataFrame
    frame: FeatureFrame
    inputs: dict[str, int]
    labels: dict[str, int]
    length: int

    def params(self) -> str:
        """The fitted stages as JSON: assemble(..., fitted=replayed) treats other data alike."""
        return self.frame.to_json()

    def input_slices(self) -> dict[str, tuple[int, int]]:
        """Where each group lies in the inputs side by side."""
        out, at = {}, 0
        for name, width in self.inputs.items():
            out[name] = (at, at + width)
            at += width
        return out


def stages(bins: int, widths: dict[str, float] | None = None, outlier: float = 0.001, discrete: tuple[str, ...] = DISCRETE, agent: str = "agent", t: str = "t", edges: dict[str, list[float]] | None = None) -> list[Stage]:
    """The stages of assemble() before they are fitted; widths and edges are in the units of the velocities."""
    keys = [agent, "session"]
    return [
        Roll("before", column="velocity_before", dt=1, keys=keys, t=t),
        VectorZScore("scale", columns=["velocity", *INPUTS]),
        VectorSplit("parts", column="velocity", names=list(VELOCITY), parts={"discrete": list(discrete), "continuous": [n for n in VELOCITY if n not in discrete]}),
        VectorBins("bins", column="velocity_discrete", bins=bins, outlier=outlier, widths=[(widths or {}).get(n, 0.0) for n in discrete], **({"edges": [edges[n] for n in discrete]} if edges else {})),
    ]


def _scaled_to(stage: Stage, frame: FeatureFrame) -> Stage:
    """Bin widths and given edges in units of the z-scored velocities: divided by each feature's deviation."""
    if not isinstance(stage, VectorBins) or "means" in stage.params:
        return stage
    parts, (mean, sd) = frame.find("parts").params["parts"]["discrete"], frame.find("scale").params["stats"]["velocity"]
    at = [VELOCITY.index(n) for n in parts]
    p = dict(stage.params, widths=[w / sd[i] for w, i in zip(stage.params["widths"], at)])
    if "edges" in p:
        p["edges"] = [[(e - mean[i]) / sd[i] for e in es] for es, i in zip(p["edges"], at)]
    return VectorBins(stage.name, **p)


def assemble(rows: DataFrame, length: int, bins: int = 10, widths: dict[str, float] | None = None, outlier: float = 0.001, offset: int = 0, mask: str | None = None, fitted: FeatureFrame | str | None = None, agent: str = "agent", t: str = "t", id: str = "id", edges: dict[str, list[float]] | None = None) -> Dataset:
    """Chunks of ``length`` rows of feature_rows().

    Inputs: the velocity of the frame before, the relative pose and the senses, z-scored. Labels: the z-scored velocity, some of it as
    bins no narrower than ``widths``. ``fitted``: the frame of the training data (or its JSON), used instead of learning.
    """
    # every fit is a pass of its own over a few columns: the senses are not computed again for each
    rows = stored(rows, "features") if fitted is None else rows
    base = rows.withColumn("velocity_before", F.col("velocity")).withColumn("_velocity", F.col("velocity"))
    if fitted is not None:
        known = fitted if isinstance(fitted, str) else list(fitted.lineage)
        frame = replay(base, known)
    else:
        # scales are learned from all rows that have the feature; bins from the labels
        frame = FeatureFrame(base)
        for stage in stages(bins, widths, outlier, agent=agent, t=t, edges=edges):
            frame = frame.then(_scaled_to(stage, frame))
    whole = frame.df.where(F.col("velocity_before").isNotNull() & F.col("velocity_continuous").isNotNull())
    # a session's first row has no velocity before it: its chunks begin one row later
    placed = whole.withColumn("session", F.col("session") + 1)
    labels = ["velocity_discrete_bins", "velocity_continuous"]
    about = [id, "pose", "_velocity"]
    chunks = sequences.chunk_examples(placed, [*INPUTS, *labels, *about, *([mask] if mask else [])], length, offset, mask, agent, t)
    first = F.get("rows", F.lit(0))
    own = lambda r: F.struct(r["pos"].alias("pos"), *[r[c].alias(c) for c in (*INPUTS, *labels)], r["_velocity"].alias("velocity"))
    chunks = chunks.select(agent, "session", "chunk_start", first[id].alias(id), first["pose"].alias("start"), F.transform("rows", own).alias("rows"))
    n_discrete = len(frame.find("parts").params["parts"]["discrete"])
    widths_ = {"velocity_before": len(VELOCITY), "relative_pose": len(RELATIVE), **SENSES}
    return Dataset(chunks, frame, widths_, {"velocity_discrete_bins": n_discrete, "velocity_continuous": len(VELOCITY) - n_discrete}, length)


def item_frame(items: DataFrame, fitted: FeatureFrame | str, agent: str = "agent", t: str = "t", id: str = "id") -> FeatureFrame:
    """Chunks, or predictions in their form, as rows with lineage: (agent, session, chunk_start, t, id, start, velocity_discrete_bins,
    velocity_continuous). invert_to("scale") and beyond undo bins, parts and scales."""
    lineage = fitted.lineage if isinstance(fitted, FeatureFrame) else replay(items, fitted, done=1 << 30).lineage
    rows = items.select(agent, "session", "chunk_start", id, "start", F.inline("rows"))
    rows = rows.select(agent, "session", "chunk_start", (F.col("chunk_start") + F.col("pos")).alias(t), id, "start", "velocity_discrete_bins", "velocity_continuous")
    # only the labels' stages can be undone from an item; the roll of the inputs is none of them
    return FeatureFrame(rows, tuple(s for s in lineage if s.name != "before"))


def item_poses(items: DataFrame, fitted: FeatureFrame | str, sizes: DataFrame, agent: str = "agent", t: str = "t", id: str = "id") -> DataFrame:
    """(agent, session, chunk_start, t, id, velocity, pose, kp): the tracks that chunks or predictions stand for, from each chunk's start."""
    back = item_frame(items, fitted, agent, t, id).invert_to().df
    posed = motion.integrate_pose(back, "velocity", "start", ANGLES, [agent, "session", "chunk_start"], t)
    wide = posed.select("*", *[F.get("pose", F.lit(i)).alias(n) for i, n in enumerate(pose.POSE)])
    return pose.keypoints(wide, sizes, id).drop(*pose.POSE, "start")
