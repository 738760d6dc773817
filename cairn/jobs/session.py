"""A captured build from its trace to the report and the bill of materials."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators import links as links_of
from cairn.operators import report, trace
from cairn.sources import files, lockfiles, packages, tracefile, wraps
from cairn.sources.store import stage


@dataclass
class Capture:
    """What was recorded of a build.

    ``trace`` is a folder of flat records, ``root`` where the build machine's
    files lie (empty: where they were), ``project`` the directory of the build
    on that machine. Tables: ``facts`` (pid, kind, content, seq) of processes,
    ``links`` (path, target), ``status`` and ``lists`` of the package database
    (pos, file_name, content), ``release`` (pos, content).
    """

    trace: str
    project: str
    facts: DataFrame
    links: DataFrame
    status: DataFrame
    lists: DataFrame
    release: DataFrame
    root: str = ""
    command: str = ""
    timestamp: str = ""
    exit_code: int | None = None


def processes(facts: DataFrame) -> DataFrame:
    """(pid, comm, cwd) of the processes of which a name or a directory was recorded."""
    return packages.process_names(facts).join(packages.process_directories(facts), "pid", "full")


def found_files(spark: SparkSession, capture: Capture, process: DataFrame, include_orchestrators: bool) -> DataFrame:
    """(path, canonical, hash) of the relevant files that are there; only local ones are read."""
    records = tracefile.records(spark, capture.trace).select(F.col("at").alias("seq"), "record")
    opened = trace.relevant_paths(packages.opens(packages.events(records)), process, capture.project, include_orchestrators)
    at = F.concat(F.lit(capture.root), F.col("path"))
    there = files.hashed(opened.select(at.alias("path")).repartition("path"), ~paths.is_system(F.substring("path", len(capture.root) + 1, 1 << 30)))
    there = stage(there.withColumn("path", F.substring("path", len(capture.root) + 1, 1 << 30)))
    led = links_of.canonical(there.select("path").filter(F.col("path").startswith("/")), capture.links).select("path", "canonical")
    # Where links go round, a path stands for itself.
    return there.join(led, "path", "left").select("path", F.coalesce("canonical", "path").alias("canonical"), "hash")


def components(spark: SparkSession, capture: Capture, include_orchestrators: bool = False, include_dev: bool = False) -> DataFrame:
    """All components of a build: of its files, then of its lock files."""
    process = stage(processes(capture.facts))
    project = capture.root + capture.project
    owned = packages.package_files(capture.lists).withColumn("pos", F.lit(0))
    known = packages.package_meta(capture.status).withColumn("pos", F.lit(0))
    index = stage(wraps.index(*files.wrap_files(spark, project)))
    traced = trace.first_of_key(trace.components(found_files(spark, capture, process, include_orchestrators), owned, known, index))
    locked = lockfiles.detected(files.lock_files(spark, project), process, include_dev)
    return traced.unionByName(lockfiles.as_components(locked))


def run(spark: SparkSession, capture: Capture, out: str, include_orchestrators: bool = False, include_dev: bool = False) -> DataFrame:
    """Write ``out``/report and ``out``/bom as lines of JSON in order; the components are evaluated once."""
    rows = stage(components(spark, capture, include_orchestrators, include_dev))
    distro = F.lit(packages.distro(packages.os_release(capture.release)).first().distro)  # one row
    when, where = F.lit(capture.timestamp), F.lit(capture.project)
    made = report.report_document(rows, when, F.lit(capture.command), where, F.lit(capture.exit_code).cast("int"))
    made.select("line").write.text(f"{out}/report")
    bom = report.with_system(report.bom_rows(rows, distro), distro)
    report.bom_document(bom, when, where, "cairn", "1").select("line").write.text(f"{out}/bom")
    return rows
