"""An experiment from config to report: scan, join, metrics, summary, files."""

from __future__ import annotations

import datetime
import json
import os
import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Experiment, Registry
from .operators import bootstrap, matching, scene_metrics as M
from .operators.ranking import checkpointed
from .sources import meshes, scenes as S

DATASETS, MODELS, METRICS = Registry("dataset"), Registry("model"), Registry("metric")


@dataclass(frozen=True)
class Metric:
    """compute(tables, parameters) gives sample_id, value; of a metric over the whole dataset one row with a value."""

    compute: Callable[[dict[str, DataFrame], dict], DataFrame]
    whole: bool = False


def per_scene(name: str):
    """Register a function of tables and parameters as a metric of scenes."""
    return lambda compute: METRICS.register(name)(Metric(compute)).compute


def per_dataset(name: str):
    return lambda compute: METRICS.register(name)(Metric(compute, True)).compute


@DATASETS.register("manifest")
def _manifest(spark: SparkSession, parameters: dict) -> DataFrame:
    """sample_id, ordinal, input, metadata, gt."""
    return S.read_manifest(spark, parameters["manifest"])


@MODELS.register("fixture")
def _fixture(spark: SparkSession, parameters: dict, manifest: DataFrame) -> DataFrame:
    """sample_id, prediction (scene JSON): stored predictions."""
    folder = parameters.get("predictions", parameters.get("prediction_dir"))
    if folder is None:
        raise ValueError("stored predictions need prediction_dir")
    return S.read_predictions(spark, folder, manifest)


DATASETS.alias("igibson", "manifest")


def tables(spark: SparkSession, experiment: Experiment) -> dict[str, DataFrame]:
    """scenes, preds, labels (boxes of either form) and the raw predictions, as the experiment's dataset and model give them."""
    # kept, so that what a run writes beside its inputs changes nothing that is read later
    manifest = checkpointed(DATASETS.get(experiment.dataset["type"])(spark, experiment.dataset["parameters"]))
    raw = checkpointed(MODELS.get(experiment.model["type"])(spark, experiment.model["parameters"], manifest))
    truth, pred = S.decoded(manifest.select("sample_id", "ordinal", "gt"), "gt"), S.decoded(raw, "prediction")
    # parsed once for all metrics
    boxed = lambda df: checkpointed(S.objects(df).select("sample_id", "obj_idx", "label", "score", S.either(F.col("bbox")).alias("box"), "attributes"))
    scenes = truth.select("sample_id", "ordinal", F.col("gt").isNotNull().alias("has_gt"), S.either(F.col("layout")).alias("gt_layout")).join(
        pred.select("sample_id", S.either(F.col("layout")).alias("pred_layout")), "sample_id"
    )
    scenes = checkpointed(scenes)
    if scenes.count() != manifest.count():
        raise ValueError("scenes and predictions are not one to one")
    return {"scenes": scenes, "preds": boxed(pred), "labels": boxed(truth), "raw": raw}


def _protocol(t: dict[str, DataFrame], p: dict) -> tuple[DataFrame, DataFrame]:
    """Predictions and labels under the metric's class map and classes."""
    return tuple(matching.class_protocol(t[k], p.get("class_map"), p.get("classes")) for k in ("preds", "labels"))


@per_scene("layout_iou_3d")
def _layout_iou(t, p):
    return M.layout_iou(t["scenes"].where("has_gt"))


@per_scene("collision_rate")
def _collisions(t, p):
    return M.collision_rate(t["scenes"], _protocol(t, p)[0], p.get("minimum_intersection", 0.0))


@per_scene("layout_violation_rate")
def _violations(t, p):
    return M.layout_violation_rate(t["scenes"], _protocol(t, p)[0], p.get("tolerance", 0.0))


@per_scene("layout_penetration")
def _penetration(t, p):
    return M.layout_penetration(t["scenes"], _protocol(t, p)[0])


@per_scene("object_map")
def _object_map(t, p):
    bound = p.get("class_map") is not None or p.get("classes") is not None
    return M.object_map(t["scenes"].where("has_gt"), *_protocol(t, p), p.get("iou_threshold", 0.5), None if bound else 0.0)


@per_dataset("object_map_dataset")
def _dataset_map(t, p):
    preds, labels = _protocol(t, p)
    per_class = M.dataset_map(preds.join(t["scenes"].where("has_gt").select("sample_id"), "sample_id", "left_semi"), labels, p.get("iou_threshold", 0.5))
    return per_class.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("value"))


def clouds(objects: DataFrame, count: int, seed: int, root: str | None) -> DataFrame:
    """sample_id, obj_idx, cloud of the objects that have a shape. Each file is read and sampled once, whoever names it."""
    points, path = S.shape_of(F.col("attributes"))
    named = objects.where("attributes['shape'] is not null").select("sample_id", "obj_idx", points.alias("points"), path.alias("path"))
    named = named.withColumn("path", S.plain(S.resolved(root, F.col("path"))) if root else S.plain(F.col("path")))
    inline = named.where("path is null").select("sample_id", "obj_idx", F.col("points").alias("cloud"))
    wanted = named.where("path is not null").select("path").distinct()
    ends = wanted.agg(F.min("path").alias("a"), F.max("path").alias("b")).first()  # all paths share what these two share
    if ends.a is None:
        return inline
    folder = os.path.commonprefix([ends.a, ends.b]).rpartition("/")[0]
    if not root and not folder.replace(":", "").strip("/"):
        raise ValueError("shapes lie in no folder of their own: give mesh_root")
    read = meshes.read_meshes(objects.sparkSession, root or folder, wanted)
    drawn = meshes.sampled_clouds(read, count, seed).withColumn("path", S.plain(F.col("path")))
    return inline.unionByName(named.join(drawn, "path").select("sample_id", "obj_idx", "cloud"))


def _shapes(t: dict[str, DataFrame], p: dict) -> DataFrame:
    """sample_id, chamfer, fscore, worked out once for metrics of equal parameters."""
    known = {k: p.get(k, d) for k, d in (("iou_threshold", 0.15), ("num_points", 2048), ("seed", 0), ("squared", True), ("fscore_threshold", 0.1), ("normalize", "none"), ("mesh_root", None))}
    if known["num_points"] <= 0:
        raise ValueError("num_points must be positive")
    key = "shapes " + repr(known)
    if key not in t:
        have = t["preds"].join(t["scenes"].where("has_gt").select("sample_id"), "sample_id", "left_semi")
        sides = [clouds(o, known["num_points"], known["seed"], known["mesh_root"]) for o in (have, t["labels"])]
        t[key] = checkpointed(M.shape_scores(have, t["labels"], *sides, known["iou_threshold"], known["normalize"], known["squared"], known["fscore_threshold"]))
    return t["scenes"].where("has_gt").select("sample_id").join(t[key], "sample_id", "left")


@per_scene("mesh_chamfer")
def _mesh_chamfer(t, p):
    return _shapes(t, p).select("sample_id", F.col("chamfer").alias("value"))


@per_scene("mesh_fscore")
def _mesh_fscore(t, p):
    return _shapes(t, p).select("sample_id", F.col("fscore").alias("value"))


def metric(kind: str, parameters: dict, t: dict[str, DataFrame]) -> DataFrame:
    """sample_id, value; of a dataset metric one row without sample_id."""
    return METRICS.get(kind).compute(t, parameters)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file in whatever store the path names, renamed over the one before, so that there is never none."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    place, made = fs.Path(path), fs.Path(path + ".part")
    store = place.getFileSystem(conf)
    out = store.create(made, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    fs.FileContext.getFileContext(store.getUri(), conf).rename(store.makeQualified(made), store.makeQualified(place), over)


def revision() -> str | None:
    """The commit of the checkout that this code is in, None outside of one."""
    try:
        found = subprocess.run(["git", "rev-parse", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return found.stdout.strip() if found.returncode == 0 else None


def run(spark: SparkSession, experiment: Experiment) -> dict[str, dict]:
    """Write predictions/, metrics.jsonl/ (a folder of parts in order), summary.json, report.md and run.json; return the summary."""
    named = {m["parameters"].get("name", m["type"]): (METRICS.get(m["type"]), m["parameters"]) for m in experiment.metrics}
    t = tables(spark, experiment)
    out = experiment.output_dir.rstrip("/")
    scores = {n: k.compute(t, p) for n, (k, p) in named.items() if not k.whole}
    summary: dict[str, dict] = {}
    if scores:
        values = checkpointed(M.long_form(scores).join(t["scenes"].select("sample_id", "ordinal"), "sample_id"))
        rows = values.where("value is not null").groupBy("sample_id", "ordinal").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
        t["scenes"].select("sample_id", "ordinal").join(rows, ["sample_id", "ordinal"], "left").orderBy("ordinal").select("sample_id", "metrics").write.mode("overwrite").json(f"{out}/metrics.jsonl")
        bounds = {r["metric"]: r for r in bootstrap.intervals(values, experiment.seed, experiment.interval_law).collect()}
        for r in M.summary(values).collect():  # a row per metric
            n = r["metric"]
            summary[n] = {"count": r["n"]} | ({"mean": r["mean"], "median": r["median"], "ci95_low": bounds[n]["ci_low"], "ci95_high": bounds[n]["ci_high"]} if r["n"] else {})
    for n, (k, p) in named.items():
        if k.whole:
            summary[n] = {"dataset": True, "value": k.compute(t, p).first()["value"]}
    t["raw"].select("sample_id", "prediction").write.mode("overwrite").parquet(f"{out}/predictions")
    _put(spark, f"{out}/summary.json", json.dumps(summary, indent=2, sort_keys=True))
    _put(spark, f"{out}/report.md", report(experiment.name, {n: summary[n] for n in named}))
    about = {"time": datetime.datetime.now(datetime.UTC).isoformat(), "spark": spark.version, "revision": revision()} | {k: getattr(experiment, k) for k in ("seed", "name", "dataset", "model", "metrics")}
    _put(spark, f"{out}/run.json", json.dumps(about, indent=2))
    return summary


def report(name: str, summary: dict[str, dict]) -> str:
    """A table with six decimals: n/a where nothing applies, a dash where a dataset value has no spread."""
    lines = [f"# {name}", "", "| metric | n | mean | median | 95% CI |", "|---|---:|---:|---:|---|"]
    for n, s in summary.items():
        if s.get("dataset"):
            lines.append(f"| {n} | – | {s['value']:.6f} | – | – |")
        elif not s["count"]:
            lines.append(f"| {n} | 0 | n/a | n/a | n/a |")
        else:
            lines.append(f"| {n} | {s['count']} | {s['mean']:.6f} | {s['median']:.6f} | [{s['ci95_low']:.6f}, {s['ci95_high']:.6f}] |")
    return "\n".join(lines) + "\n"
