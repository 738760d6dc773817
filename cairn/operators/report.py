"""Report order and bill-of-materials rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import versions
from cairn.sources.store import stage

ORDER = ("type", "name", "version", "path")


def ordered(components: DataFrame) -> DataFrame:
    """Total order by (type, name, version, path); the types' names sort like their ranks."""
    return components.orderBy(*ORDER)


def sorted_parts(rows: DataFrame, order) -> DataFrame:
    """``rows`` in order over range partitions, written, with a number ``at`` that grows in that order."""
    return stage(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))


def numbered(components: DataFrame) -> DataFrame:
    """Components with their place in the order within their type.

    Rows are sorted over range partitions. A place is the row's number in its
    partition, and how many of its type earlier partitions have; only those
    counts, a few a partition, meet in one task.
    """
    rows = sorted_parts(components, ORDER).withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("type", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.sum("n").over(Window.partitionBy("type").orderBy("part")) - F.col("n")
    offsets = counts.select("type", "part", "first", earlier.alias("earlier"))
    place = (F.col("at") - F.col("first") + F.col("earlier") + 1).cast("int")
    return rows.join(offsets, ["type", "part"]).select(*components.columns, place.alias("place"))


def bom_rows(components: DataFrame, distro: Column) -> DataFrame:
    """One bill-of-materials row a component: purl, version, hash and occurrence by type."""
    kind = F.col("type")
    local = kind == "local_file"
    shown = F.when(local, F.coalesce("version", "hash")).otherwise(F.col("version"))
    system = versions.system_purl(F.col("name"), F.col("version"), F.col("arch"), F.col("src_name"), distro)
    purl = F.when(kind == "system_package", system).when(local, versions.local_purl(F.col("name"), shown)).when(kind == "ecosystem_package", F.col("purl"))
    sha = F.when(local & (F.col("hash") != "sha256:error"), F.substring("hash", 8, 64))
    return components.select("type", "path", "name", purl.alias("purl"), shown.alias("version"), sha.alias("sha256"), F.when(kind != "ecosystem_package", F.col("path")).alias("occurrence"))


def project_name(directory: Column) -> Column:
    """Last segment of the project's directory."""
    name = F.regexp_extract(directory, r"([^/]+)/*\z", 1)
    return F.when(name != "", name).otherwise(F.lit("unknown"))


def with_system(rows: DataFrame, distro: Column) -> DataFrame:
    """Bill-of-materials rows after the one of the operating system, told by ``place`` (0 and 1)."""
    name, version = F.substring_index(distro, "-", 1), F.nullif(F.regexp_extract(distro, "^[^-]*-(.*)$", 1), F.lit(""))
    none = F.lit(None).cast("string")
    system = rows.sparkSession.range(1).select(
        F.lit(0).alias("place"), F.lit("operating-system").alias("type"), none.alias("path"), name.alias("name"), none.alias("purl"), version.alias("version"), none.alias("sha256"), none.alias("occurrence")
    )
    return system.unionByName(rows.withColumn("place", F.lit(1)))


def component_json() -> Column:
    """A report component; keys without a value are left out."""
    return F.to_json(F.struct("name", "version", "arch", "src_name", "hash", "purl", "vcs_url", "path", F.col("type").alias("component_type")))


def quoted(value: Column) -> Column:
    """A JSON text, or null."""
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def document(head: Column, rows: DataFrame, order: list[str], foot: str) -> DataFrame:
    """Lines of a JSON document: a head, one line an item of ``rows`` (with ``json``) in order, a foot.

    The items are sorted over all tasks, written once and never gathered:
    ``line`` in order is the document, as ``write.text`` leaves it in its part
    files. All items but the first begin with a comma.
    """
    items = sorted_parts(rows.select(*order, "json"), order)
    lines = rows.sparkSession.sql("SELECT 1 AS part, at, concat(CASE WHEN at = (SELECT min(at) FROM {items}) THEN '' ELSE ',' END, json) AS line FROM {items}", items=items)
    one = rows.sparkSession.range(1)
    none = F.lit(None).cast("long").alias("at")
    ends = one.select(F.lit(0).alias("part"), none, head.alias("line")).union(one.select(F.lit(2), none, F.lit(foot)))
    return ends.unionByName(lines).orderBy("part", "at").select("part", "line")


def report_document(components: DataFrame, timestamp: Column, command: Column, directory: Column, exit_code: Column) -> DataFrame:
    """The report as lines of JSON; an unknown exit code is kept as null."""
    head = F.concat(F.lit('{"timestamp":'), quoted(timestamp), F.lit(',"build_command":'), quoted(command), F.lit(',"project_dir":'), quoted(directory), F.lit(',"exit_code":'), F.coalesce(exit_code.cast("string"), F.lit("null")), F.lit(',"components":['))
    return document(head, components.withColumn("json", component_json()), ["type", "name", "version", "path"], "]}")


def bom_json() -> Column:
    """A bill-of-materials component; keys without a value are left out."""
    system = F.col("place") == 0
    reference = F.when(system, F.lit("os-component")).otherwise(F.col("purl"))
    kind = F.when(system, F.lit("operating-system")).otherwise(F.lit("library"))
    hashes = F.when(F.col("sha256").isNotNull(), F.array(F.struct(F.lit("SHA-256").alias("alg"), F.col("sha256").alias("content"))))
    evidence = F.when(F.col("occurrence").isNotNull(), F.struct(F.array(F.struct(F.col("occurrence").alias("location"))).alias("occurrences")))
    return F.to_json(F.struct(reference.alias("bom-ref"), kind.alias("type"), "name", "version", "purl", hashes.alias("hashes"), evidence.alias("evidence")))


def bom_document(rows: DataFrame, timestamp: Column, directory: Column, tool: str, tool_version: str) -> DataFrame:
    """The bill of materials as lines of JSON, the operating system first."""
    head = F.concat(
        F.lit('{"$schema":"http://cyclonedx.org/schema/bom-1.6.schema.json","bomFormat":"CycloneDX","specVersion":"1.6","version":1,"serialNumber":"urn:uuid:'), F.uuid(), F.lit('","metadata":{"timestamp":'), quoted(timestamp),
        F.lit(f',"tools":{{"components":[{{"type":"application","name":"{tool}","version":"{tool_version}"}}]}},"component":{{"bom-ref":"root-component","type":"application","name":'), quoted(project_name(directory)), F.lit('}},"components":['),
    )
    return document(head, rows.withColumn("json", bom_json()), ["place", "type", "name", "version", "path"], "]}")
