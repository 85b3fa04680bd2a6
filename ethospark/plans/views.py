"""Behaviour-shaped views over the given tables (poses, signals, labels, boxes…)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethospark.operators.frames import number_frames, runs
from ethospark.session import ensure_checkpoint_dir
from ethospark.skeleton import NUM_KEYPOINTS

STATE = "CASE WHEN event_type IN ('purchase', 'click') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END"
HOUR_BUCKET = 6  # hours of events numbered together


class Views:
    """The views, built lazily from the Parquet files in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stored(self, df: DataFrame) -> DataFrame:
        """A view written down once, for queries that read it many times."""
        ensure_checkpoint_dir(self.spark)
        return df.checkpoint()

    # --- sequences from the event table: one animal per user -------------------------
    def sequence(self) -> DataFrame:
        """Events as frames: video, identity, frame, and the event columns."""
        events = self.table("events")
        rows = events.selectExpr(
            "concat('video', user_id % 7) AS video", "user_id AS identity",
            "event_id", "event_type", "value", "props", "ts",
        )
        return number_frames(
            rows, ["video", "identity"], ["ts", "event_id"],
            f"floor(unix_timestamp(date_trunc('hour', ts)) / {3600 * HOUR_BUCKET})",
        )

    def signal(self) -> DataFrame:
        """A feature column with gaps: NULL where the event is an error."""
        return self.sequence().selectExpr(
            "video", "identity", "frame", "CASE WHEN event_type <> 'error' THEN value END AS value"
        )

    def angle(self) -> DataFrame:
        """A circular feature in [-180, 180)."""
        turned = F.col("value") * 7.3
        return self.signal().withColumn(
            "value", turned - 360 * F.floor((turned + 180) / 360).cast("double")
        )

    def state(self) -> DataFrame:
        """Class vector: 1 behaviour, 0 not, -1 no prediction."""
        return self.sequence().selectExpr("video", "identity", "frame", f"{STATE} AS state")

    def prediction(self) -> DataFrame:
        """Binary predictions of two behaviours (the second is the first one inverted)."""
        base = self.sequence().selectExpr(
            "video", "identity", "frame", f"{STATE} AS cls",
            f"CASE WHEN {STATE} = -1 THEN 0.0D ELSE 0.5D + (event_id % 50) / 100.0D END AS prob",
        )
        walk = base.withColumn("behavior", F.lit("walk"))
        rest = base.withColumn("behavior", F.lit("rest")).withColumn(
            "cls", F.when(F.col("cls") == -1, -1).otherwise(1 - F.col("cls"))
        )
        return walk.unionByName(rest)

    def label_a(self) -> DataFrame:
        """First annotator's labelled frames (label 0/1; no row = no label)."""
        return (
            self.state().filter(F.col("state") != -1).withColumnRenamed("state", "label")
        )

    def label_b(self) -> DataFrame:
        """Second annotator's labelled frames."""
        return (
            self.sequence()
            .withColumn("label", (F.col("event_id") % 3 - 1).cast("int"))
            .filter(F.col("label") >= 0)
            .select("video", "identity", "frame", "label")
        )

    def label_block(self) -> DataFrame:
        """Label blocks of several behaviours: one behaviour per event type group."""
        walk = self._blocks(self.label_a(), "walk")
        rest = self._blocks(self.label_b(), "rest")
        return walk.unionByName(rest)

    @staticmethod
    def _blocks(frames: DataFrame, behavior: str) -> DataFrame:
        return runs(frames, ["video", "identity"], ["label"]).select(
            "video", "identity", F.lit(behavior).alias("behavior"), "start", "end",
            (F.col("label") == 1).alias("present"),
        )

    def label_multi(self) -> DataFrame:
        """Exclusive labelling: at most one behaviour (or the background track) per frame."""
        behavior = (
            F.when(F.col("event_type").isin("purchase", "signup"), "walk")
            .when(F.col("event_type") == "click", "rest")
            .when(F.col("event_type") == "view", "None")
        )
        return (
            self.sequence()
            .withColumn("behavior", behavior)
            .filter(F.col("behavior").isNotNull())
            .select(
                "video", "identity", "behavior", "frame",
                (F.col("event_type") != "signup").cast("int").alias("label"),
            )
        )

    def label_frame(self) -> DataFrame:
        """Two behaviours labelled independently of each other (they do overlap)."""
        walk = self.label_a().withColumn("behavior", F.lit("walk"))
        return walk.unionByName(self.label_b().withColumn("behavior", F.lit("rest")))

    def present(self) -> DataFrame:
        """Frames with the animal in view."""
        return self.sequence().filter(F.col("value") > 5).select("video", "identity", "frame")

    def lengths(self) -> DataFrame:
        """Frames per sequence."""
        return self.sequence().groupBy("video", "identity").agg(
            (F.max("frame") + 1).alias("num_frames")
        )

    def event_run(self) -> DataFrame:
        """Runs of one event type."""
        return runs(self.sequence(), ["video", "identity"], ["event_type"]).select(
            "video", "identity", "start", "end", "event_type"
        )

    def num_frames(self) -> DataFrame:
        """Video lengths: the longest sequence of the video."""
        return self.sequence().groupBy("video").agg(
            (F.max("frame") + 1).alias("num_frames")
        )

    def annotation(self) -> DataFrame:
        """Timeline annotations: runs of one event type, tagged with it."""
        found = runs(self.sequence(), ["video", "identity"], ["event_type"])
        return found.select(
            "video", "start", "end", F.col("event_type").alias("tag"),
            F.lit("#00ff00").alias("color"), F.lit(None).cast("string").alias("description"),
            F.when(F.col("start") % 5 != 0, F.col("identity")).alias("identity"),
        )

    # --- poses from the embedding table: three animals per video ---------------------
    def raw_instance(self) -> DataFrame:
        """One row per detected instance before identities are known."""
        x = "(double(embedding[{}]) + 1) * 400 + 90 * (vec_id % 3)"
        y = "(double(embedding[{}]) + 1) * 400 + 60 * (vec_id % 3)"
        points = ", ".join(
            f"named_struct('x', {x.format(2 * k)}, 'y', {y.format(2 * k + 1)}, "
            f"'conf', double(embedding[{24 + k}]) + 0.5D)"
            for k in range(NUM_KEYPOINTS)
        )
        rows = self.table("embeddings").selectExpr(
            "concat('v', label) AS video", "int(vec_id % 3) AS instance", "vec_id",
            "int(vec_id % 3 + 1) AS embed_id", "int(double(embedding[43]) > 0.15D) AS id_mask",
            f"array({points}) AS keypoints", "embedding",
        )
        return number_frames(
            rows, ["video", "instance"], ["vec_id"], "floor(vec_id / 4096)"
        )

    def pose(self) -> DataFrame:
        """Identity poses in wide form: x_0…x_11, y_0…y_11, NULL where not confident."""
        from ethospark.operators.pose import widen

        return widen(
            self.raw_instance().select(
                "video", F.col("instance").alias("identity"), "frame", "keypoints"
            )
        )

    def track(self) -> DataFrame:
        """Raw tracks: one row per (video, frame, track); two labels share a video."""
        rows = self.table("embeddings").select(
            F.concat(F.lit("v"), F.col("label") % 5).alias("video"),
            F.floor(F.col("vec_id") / 10).cast("int").alias("frame"),
            (F.floor(F.col("vec_id") / 100) * 10 + F.col("label")).cast("bigint").alias("track_id"),
        ).distinct()
        order = Window.partitionBy("video", "frame").orderBy("track_id")  # two tracks at most
        return rows.withColumn("instance", (F.row_number().over(order) - 1).cast("int"))

    def boxes(self) -> tuple[DataFrame, DataFrame]:
        """Bounding boxes by identity of two pose versions (the second one shifted)."""
        e = _elements()
        raw = self.raw_instance()
        x, y = (e(37) + 1) * 400, (e(38) + 1) * 400
        w, h = (F.abs(e(39)) + 0.2) * 300, (F.abs(e(40)) + 0.2) * 300
        src = raw.select(
            "video", F.col("instance").alias("identity"), "frame",
            x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"),
        )
        dx, dy = e(41) * 40, e(42) * 40
        dst = raw.select(
            "video", ((F.col("instance") + 1) % 3).alias("identity"), "frame",
            (x + dx).alias("x1"), (y + dy).alias("y1"),
            (x + w + dx).alias("x2"), (y + h + dy).alias("y2"),
        )
        return src, dst

    def contour(self) -> DataFrame:
        """Contours per animal and frame: 8 padded points around their mean, and a small hole."""
        e = _elements()
        points = F.array(*[
            F.struct(
                F.floor((e(45 + 2 * i) + 1) * 400).cast("double").alias("x"),
                F.floor((e(46 + 2 * i) + 1) * 400).cast("double").alias("y"),
            )
            for i in range(8)
        ])
        mean = lambda axis: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[axis]) / 8
        angle = lambda p: F.atan2(p["y"] - F.col("my"), p["x"] - F.col("mx"))
        around = F.transform(
            F.array_sort(F.transform("points", lambda p: F.struct(angle(p).alias("a"), p.alias("p")))),
            lambda s: s["p"],
        )
        inner = F.transform(
            "around",
            lambda p: F.struct(
                F.floor(F.col("mx") + (p["x"] - F.col("mx")) / 4).cast("double").alias("x"),
                F.floor(F.col("my") + (p["y"] - F.col("my")) / 4).cast("double").alias("y"),
            ),
        )
        padding = F.array(F.struct(F.lit(-1.0).alias("x"), F.lit(-1.0).alias("y")))
        both = F.array(
            F.struct(F.lit(0).alias("contour"), F.lit(True).alias("is_external"),
                     F.concat("around", padding).alias("pts")),
            F.struct(F.lit(1).alias("contour"), F.lit(False).alias("is_external"), inner.alias("pts")),
            F.struct(F.lit(2).alias("contour"), F.lit(True).alias("is_external"), padding.alias("pts")),
        )
        seg_id = F.when(F.col("id_mask") == 0, F.col("embed_id")).otherwise(0)
        return (
            self.raw_instance()
            .withColumns({"points": points, "seg_id": seg_id})
            .withColumns({"mx": mean("x"), "my": mean("y")})
            .withColumn("around", around)
            .select("video", "frame", "seg_id", F.explode(both).alias("c"))
            .select("video", "frame", "seg_id", "c.*")
        )

    def static_object(self) -> DataFrame:
        """The arena of every video: corners, two 3-point lixits, a food hopper."""
        videos = self.table("embeddings").select(
            F.concat(F.lit("v"), F.col("label")).alias("video")
        ).distinct()
        return videos.select(
            "video", F.explode(reduce(F.concat, [
                _points("corners", [CORNERS]),
                _points("lixit", LIXITS),
                _points("food_hopper", [HOPPER]),
            ])).alias("o"),
        ).select("video", "o.*")

    def dynamic_object(self) -> DataFrame:
        """Sparse samples of a moving object: the purchases of each sequence."""
        return self.sequence().filter(F.col("event_type") == "purchase").select(
            "video", "identity", F.col("frame").alias("sample_frame"),
            F.lit(1).alias("n"), F.col("value").alias("x"),
        )

    # --- detector evaluation ----------------------------------------------------------
    def detections(self) -> tuple[DataFrame, DataFrame]:
        """Detections and ground truths of 5 keypoints; 16 vectors make one image."""
        e = _elements()
        xs = [e(2 * k + 1) * 100 for k in range(5)]
        ys = [e(2 * k + 2) * 100 for k in range(5)]
        rows = self.table("embeddings").select(
            F.floor(F.col("vec_id") / 16).cast("int").alias("image"),
            F.col("vec_id"),
            F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in zip(xs, ys)]).alias("points"),
            (e(61) + 0.5).alias("score"),
            F.least(*xs).alias("x1"), F.least(*ys).alias("y1"),
            F.greatest(*xs).alias("x2"), F.greatest(*ys).alias("y2"),
            (e(62) > 0.2).alias("crowd"),
            F.array(*[(e(50 + k) > -0.2).cast("int") for k in range(5)]).alias("visible"),
        )
        detection = rows.filter(F.col("vec_id") % 2 == 0).select(
            "image", (F.col("vec_id") % 16).cast("int").alias("det"), "score", "points",
            "x1", "y1", "x2", "y2",
        )
        truth = rows.filter(F.col("vec_id") % 2 == 1).select(
            "image", (F.col("vec_id") % 16).cast("int").alias("gt"), "crowd", "points", "visible",
            "x1", "y1", "x2", "y2",
        )
        return detection, truth

    # --- training matrix ---------------------------------------------------------------
    def matrix(self) -> DataFrame:
        """Feature rows with label and group: text statistics of the labelled documents."""
        docs = self.table("documents").join(self.table("labels"), "doc_id")
        chars = F.length("text").cast("double")
        words = F.size(F.split("text", " ")).cast("double")
        lines = F.size(F.split("text", "\n")).cast("double")
        return docs.select(
            "doc_id", "source", "lang", "quality", "toxic",
            chars.alias("n_letters"), words.alias("left_words"), lines.alias("right_words"),
            F.when(lines > 1, words / (lines - 1)).alias("LEFT_ratio"),
            F.when(lines > 1, chars / words).alias("right_RATIO"),
        )

    def file_names(self) -> DataFrame:
        """Pose file paths of the pages' users, several versions per video."""
        users = self.table("events").select("user_id").distinct()
        return users.select(
            F.explode(F.sequence(F.lit(2), F.lit(2) + (F.col("user_id") % 7).cast("int"))).alias("v"),
            "user_id",
        ).select(
            F.concat(
                F.lit("/data/"), F.lit("cage_"), (F.col("user_id") % 7).cast("string"), F.lit("_"),
                F.col("user_id").cast("string"), F.lit("_pose_est_v"), F.col("v").cast("string"),
                F.lit(".h5"),
            ).alias("path")
        )


CORNERS = [(100, 100), (700, 700), (100, 700), (700, 100)]
LIXITS = [[(62, 166), (50, 150), (50, 182)], [(740, 400), (752, 384), (752, 416)]]
HOPPER = [(330, 291), (330, 528), (444, 518), (444, 296)]


def _points(name: str, instances: list[list[tuple[int, int]]]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(name).alias("object"), F.lit(i).alias("instance"), F.lit(p).alias("point"),
            F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"),
        )
        for i, points in enumerate(instances)
        for p, (x, y) in enumerate(points)
    ])


def _elements():
    """n-th element (1-based) of the embedding as DOUBLE."""
    return lambda n: F.element_at("embedding", n).cast("double")
