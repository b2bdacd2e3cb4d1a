"""One consistent table out of files whose fields are renamed, added, removed or change type.

Each file has a schema: its fields in order with the type and the forms of their values, told apart by a fingerprint.
A feed's files in order form versions, a new one wherever the fingerprint changes; between two versions stand
explicit migration steps (rename, default, drop, cast). A version's route is the chain of the steps from it to the
newest version of its feed: renames follow a field from name to name, casts add up, a field that the version lacks gets
the default; a drop ends no value, as the fields of all versions are kept. Lines are routed by their file's
version: a route says for each field of the result where it stands in the line and by which rules it is cast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstream.functions.text import INTEGER, INFINITE, NAN_TOKENS, NULL_TOKENS, NUMBER, trimmed
from siltstream.session import materialise, sized
from siltstream.sources.csv_rejects import judged_lines, split_line

# The names under which each field of an export is known.
ALIASES = {
    "timestamp": ["Timestamp"],
    "src_ip": ["Src IP", "src_ip", "SrcAddr", "Source IP", "Src IP Address", "SOURCE_ADDRESS", "Origin Addr"],
    "src_port": ["Src Port", "src_port", "SPort", "SrcPort", "Source Port", "SOURCE_PORT", "Origin Port"],
    "dst_ip": ["Dst IP", "dst_ip", "DstAddr", "Destination IP", "Dst IP Address", "DEST_ADDRESS", "Target Addr"],
    "dst_port": ["Dst Port", "dst_port", "DPort", "DstPort", "Destination Port", "DEST_PORT", "Target Port"],
    "protocol": ["Protocol", "protocol", "Proto", "IP Protocol"],
    "flow_duration": ["Flow Duration", "flow_duration", "FlowDur", "Duration Of Flow"],
    "tot_fwd_pkts": ["Tot Fwd Pkts", "tot_fwd_pkts", "Total Fwd Packets"],
    "tot_bwd_pkts": ["Tot Bwd Pkts", "tot_bwd_pkts", "Total Bwd Packets"],
    "totlen_fwd_pkts": ["TotLen Fwd Pkts", "totlen_fwd_pkts", "Total Length Fwd Packets"],
    "totlen_bwd_pkts": ["TotLen Bwd Pkts", "totlen_bwd_pkts", "Total Length Bwd Packets"],
    "flow_byts_s": ["Flow Byts/s", "flow_byts_s", "Flow Bytes/s"],
    "flow_pkts_s": ["Flow Pkts/s", "flow_pkts_s", "Flow Packets/s"],
    "label": ["Label"],
}
#: Words that mean the same in the name of a field that is no listed alias.
SAME_WORDS = {"source": "src", "origin": "src", "destination": "dst", "dest": "dst", "target": "dst", "address": "ip", "addr": "ip", "packets": "pkts", "bytes": "byts", "total": "tot", "duration": "dur"}
#: A fraction other than zero: durations in microseconds are whole, so a file with one gives milliseconds.
FRACTION = r"^[+-]?[0-9]*\.[0-9]*[1-9][0-9]*$"
PROTOCOLS = {"hopopt": 0, "icmp": 1, "tcp": 6, "udp": 17}
TYPES = ["integer", "decimal", "text"]


def canonical(name: Column) -> Column:
    """The field that a header name stands for; an unknown name stands for itself, but for case, marks and like words."""
    known = {alias: field for field, names in ALIASES.items() for alias in names}
    lookup = F.create_map(*[F.lit(x) for x in chain(*known.items())])
    words = F.regexp_replace(F.lower(F.regexp_replace(trimmed(name), r"([a-z0-9])([A-Z])", "$1_$2")), r"[^a-z0-9]+", "_")
    for word, same in SAME_WORDS.items():
        words = F.regexp_replace(words, rf"(^|_){word}(?=_|$)", f"$1{same}")
    words = F.btrim(words, F.lit("_"))
    known_words = {w: field for field, names in ALIASES.items() for w in [field]}
    guess = F.create_map(*[F.lit(x) for x in chain(*known_words.items())])
    return F.coalesce(lookup[name], guess[words], words)


def value_type(value: Column) -> Column:
    """0 integer, 1 decimal, 2 text; null for a token that stands for no value."""
    token = F.lower(trimmed(value))
    absent = value.isNull() | (token == "") | token.isin(NAN_TOKENS + NULL_TOKENS) | token.rlike(INFINITE)
    return F.when(absent, None).when(token.rlike(INTEGER), 0).when(token.rlike(NUMBER), 1).otherwise(2)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [split_line((line or "").removesuffix("\r")) or [] for line in batch.column("raw_line").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.list_(pa.string()))], ["feed", "source_file", "file_seq", "header"])


#: What a cast has to undo, by the form that values of a field have in a version.
RULES = {"dotted": 1, "hexadecimal": 2, "prefixed": 4, "decimal": 8, "named": 16, "milliseconds": 32}
HEXADECIMAL, PREFIXED, ZERO_FRACTION = r"(?i)^0x[0-9a-f]+$", r"(?i)^(p|[a-z]+/)[0-9]+$", r"^[+-]?[0-9]+\.0*$"
ADDRESSES, PORTS = ["src_ip", "dst_ip"], ["src_port", "dst_port"]


def _rules(field: Column, value: Column) -> Column:
    """The rules that a value needs to be cast, as a sum of RULES."""
    rule = lambda name, test: F.when(test, RULES[name]).otherwise(0)
    port = field.isin(PORTS)
    return (
        rule("dotted", field.isin(ADDRESSES) & value.rlike(r"^[0-9]{1,10}$"))
        + rule("hexadecimal", port & value.rlike(HEXADECIMAL))
        + rule("prefixed", port & value.rlike(PREFIXED))
        + rule("decimal", field.isin(*PORTS, "protocol", "tot_fwd_pkts", "tot_bwd_pkts") & value.rlike(ZERO_FRACTION))
        + rule("named", (field == "protocol") & value.rlike(r"(?i)^[a-z]"))
        + rule("milliseconds", (field == "flow_duration") & value.rlike(FRACTION))
    )


def file_fields(raw: DataFrame, judged: DataFrame) -> DataFrame:
    """(feed, source_file, file_seq, position, name, field, value_type, rules): one row per field of a file's header.

    value_type and rules (the casts its values need) cover all values of the lines without a reason in judged; the type
    is null if there are none. Of several names for one field the first is kept, the others count as fields of their own
    name. Written to the shared folder, as several results read it.
    """
    headers = raw.where("source_line = 1").select("feed", "source_file", "file_seq", "raw_line").mapInArrow(_headers, "feed string, source_file string, file_seq int, header array<string>")
    fields = headers.select("feed", "source_file", "file_seq", F.posexplode("header").alias("position", "name"))
    fields = fields.withColumn("field", canonical(F.col("name")))
    first = F.row_number().over(Window.partitionBy("source_file", "field").orderBy("position"))
    fields = materialise(fields.withColumn("field", F.when(first == 1, F.col("field")).otherwise(F.concat(F.lit("="), F.col("name")))), "header-fields")
    sound = judged.where((F.col("source_line") > 1) & (F.size("reasons") == 0))
    # every distinct value of a field is looked at once
    values = sound.select("source_file", F.posexplode("fields").alias("position", "value")).withColumn("value", trimmed(F.col("value")))
    named = fields.where(F.col("field").isin(*ADDRESSES, *PORTS, "protocol", "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts")).select("source_file", "position", F.col("field").alias("ruled"))
    values = values.join(sized(named), ["source_file", "position"], "left")
    types = values.groupBy("source_file", "position").agg(F.max(value_type(F.col("value"))).alias("kind"), F.bit_or(F.coalesce(_rules(F.col("ruled"), F.col("value")), F.lit(0))).alias("rules"))
    kind = F.when(F.col("kind") == 0, TYPES[0]).when(F.col("kind") == 1, TYPES[1]).when(F.col("kind") == 2, TYPES[2]).alias("value_type")
    typed = fields.join(types, ["source_file", "position"], "left").select("feed", "source_file", "file_seq", "position", "name", "field", kind, F.coalesce("rules", F.lit(0)).alias("rules"))
    return materialise(typed, "fields")


def _rule_names(rules: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(rules.bitwiseAND(bit) > 0, name) for name, bit in RULES.items()])), "+")


def file_versions(fields: DataFrame) -> DataFrame:
    """(feed, source_file, file_seq, earlier, fingerprint, version, is_new): the file before in the feed, the fingerprint
    of names, types and rules, and the number of the version, a new one wherever the fingerprint changes. Written to
    the shared folder. One row per file."""
    part = F.concat_ws(":", "field", "name", F.coalesce("value_type", F.lit("-")), F.col("rules").cast("string"))
    files = fields.groupBy("feed", "source_file", "file_seq").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "|"), 256).alias("fingerprint"))
    order = Window.partitionBy("feed").orderBy("file_seq", "source_file")
    files = files.withColumns({"earlier": F.lag("source_file").over(order), "is_new": ~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(order))})
    return materialise(files.withColumn("version", F.sum(F.col("is_new").cast("bigint")).over(order)), "versions")


def migration_steps(fields: DataFrame, files: DataFrame) -> DataFrame:
    """(source_file, step, field, old_name, name, old_type, value_type): the steps from the file before to the file, for the
    files that begin a version; step is rename, default, drop or cast. A file whose fingerprint stays has none."""
    new = files.where("is_new and earlier is not null").select("source_file", "earlier")
    now = fields.join(sized(new.select("source_file")), "source_file").select("source_file", "field", "name", "value_type", F.lit(1).alias("now"))
    old = fields.withColumnRenamed("source_file", "earlier").join(sized(new), "earlier").select("source_file", "field", F.col("name").alias("old_name"), F.col("value_type").alias("old_type"), F.lit(1).alias("before"))
    both = now.join(old, ["source_file", "field"], "full")
    steps = F.array_compact(
        F.array(
            F.when(F.col("before").isNull(), "default"),
            F.when(F.col("now").isNull(), "drop"),
            F.when(F.col("name") != F.col("old_name"), "rename"),
            F.when(F.col("value_type") != F.col("old_type"), "cast"),
        )
    )
    return both.select("source_file", F.explode(steps).alias("step"), "field", "old_name", "name", "old_type", "value_type")


def schema_changes(raw: DataFrame, classes: DataFrame) -> DataFrame:
    """(source_file, change_kind, field_name), every change of a file against the one before it in its feed, read off the
    migration steps.

    Order is no change; a field without any value has no type and so no change of type; a feed's first file has
    no changes. Empty in, empty out.
    """
    fields = file_fields(raw, judged_lines(raw, classes))
    steps = migration_steps(fields, file_versions(fields))
    kinds = F.create_map(*[F.lit(x) for x in chain(*{"default": "added", "drop": "removed", "rename": "renamed", "cast": "type_changed"}.items())])
    return steps.select("source_file", kinds[F.col("step")].alias("change_kind"), F.coalesce("name", "old_name").alias("field_name"))


def schema_versions(raw: DataFrame, classes: DataFrame) -> DataFrame:
    """(feed, source_file, file_seq, fingerprint, version, steps): steps lead from the file before to this one."""
    fields = file_fields(raw, judged_lines(raw, classes))
    files = file_versions(fields)
    text = (
        F.when(F.col("step") == "rename", F.concat_ws(" ", F.lit("rename"), "old_name", F.lit("to"), "name"))
        .when(F.col("step") == "cast", F.concat_ws(" ", F.lit("cast"), "field", "old_type", F.lit("to"), "value_type"))
        .otherwise(F.concat_ws(" ", "step", "field"))
    )
    steps = migration_steps(fields, files).groupBy("source_file").agg(F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("steps"))
    return files.join(steps, "source_file", "left").select("feed", "source_file", "file_seq", "fingerprint", "version", F.coalesce("steps", F.lit("")).alias("steps"))


def version_routes(fields: DataFrame, files: DataFrame) -> DataFrame:
    """(feed, version, target_version, field, position, name, target_name, rules), one row per version and field of its feed.

    target_name is where the chained renames lead: the field's name in the newest version that has it, at or after
    this one (for a field that only comes before, its last). position, that in the version's first file, name and rules are null where the route gives the default."""
    heads = files.where("is_new").select("feed", "version", "source_file")
    known = heads.join(fields.drop("feed", "file_seq"), "source_file").drop("source_file")
    named = known.groupBy("feed", "field").agg(F.max_by("name", "version").alias("last_name"))
    chained = Window.partitionBy("feed", "field").orderBy("version").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = known.select("feed", "version", "field", "position", "name", "rules", F.last("name").over(chained).alias("led"))
    last = Window.partitionBy("feed")
    versions = heads.select("feed", "version", F.max("version").over(last).alias("target_version"))
    return versions.join(named, "feed").join(own, ["feed", "version", "field"], "left").select("feed", "version", "target_version", "field", "position", "name", F.coalesce("led", "last_name").alias("target_name"), "rules")


def migration_routes(raw: DataFrame, classes: DataFrame) -> DataFrame:
    """version_routes with the rules by name: a rename, a default and the casts of each field, '' if nothing is to be done."""
    fields = file_fields(raw, judged_lines(raw, classes))
    routes = version_routes(fields, file_versions(fields))
    done = F.array_compact(F.array(F.when(F.col("position").isNull(), "default"), F.when(F.col("name") != F.col("target_name"), "rename"), F.when(F.col("rules") > 0, F.concat(F.lit("cast "), _rule_names(F.col("rules"))))))
    return routes.select("feed", "version", "target_version", "field", "position", "name", "target_name", F.array_join(done, "; ").alias("rules"))


def _address(value: Column, rules: Column) -> Column:
    """Dotted form of an address, which some versions give as one integer."""
    whole = F.when((rules.bitwiseAND(RULES["dotted"]) > 0) & value.rlike(r"^[0-9]{1,10}$"), value.try_cast("bigint"))
    byte = lambda shift: F.shiftright(whole, shift).bitwiseAND(255)
    return F.when(whole.isNotNull(), F.concat_ws(".", *[byte(s).cast("string") for s in (24, 16, 8, 0)])).otherwise(value)


def _whole(value: Column, rules: Column) -> Column:
    """A whole number, as the rules of the version say: 80, 80.0, 0x50, p80, tcp/80."""
    on = lambda name: rules.bitwiseAND(RULES[name]) > 0
    return (
        F.when(on("hexadecimal") & value.rlike(HEXADECIMAL), F.conv(F.substring(value, 3, 100), 16, 10).try_cast("bigint"))
        .when(on("prefixed") & value.rlike(PREFIXED), F.regexp_replace(value, r"(?i)^(p|[a-z]+/)", "").try_cast("bigint"))
        .when(on("decimal") & value.rlike(ZERO_FRACTION), F.regexp_replace(value, r"\.0*$", "").try_cast("bigint"))
        .when(value.rlike(INTEGER), value.try_cast("bigint"))
    )


def consistent_table(raw: DataFrame, classes: DataFrame) -> DataFrame:
    """The sound lines of all files in the canonical fields; fields of no canonical name go into a map, extra.

    Each line takes the route of its file's version. Missing fields are null, tokens without a value too. Casts: integer
    addresses become dotted, ports in any form whole, protocol names numbers, durations microseconds; duration_unit is
    the unit of the line's version. Values that are there but don't cast, infinite ones too, are null and kept as written
    in a map, uncast.
    """
    judged = judged_lines(raw, classes).where((F.col("source_line") > 1) & (F.size("reasons") == 0))
    # the lines are parsed once, for the types of their fields and for the table
    sound = materialise(judged.select("line_id", "feed", "source_file", "source_line", "fields", "reasons"), "sound")
    fields = file_fields(raw, sound)
    files = file_versions(fields)
    routes = version_routes(fields, files).where("position is not null")
    other = F.when(~F.col("field").isin(*ALIASES), F.struct("position", "field"))
    at = [F.max(F.when(F.col("field") == f, F.struct("position", "rules"))).alias(f"_{f}") for f in ALIASES]
    # order is no change of version, so each file's own header says where its fields stand
    own = fields.select("source_file", "field", "position").join(files.select("source_file", "feed", "version"), "source_file")
    routed = own.join(routes.select("feed", "version", "field", "rules"), ["feed", "version", "field"])
    routed = routed.groupBy("source_file").agg(F.array_sort(F.collect_list(other)).alias("_others"), *at)
    lines = sound.join(sized(materialise(routed, "routes"), 20_000), "source_file")

    def written(name: str) -> Column:
        token = trimmed(F.get("fields", F.col(f"_{name}.position")))
        return F.when(~((token == "") | F.lower(token).isin(NAN_TOKENS + NULL_TOKENS)), token)

    lines = lines.withColumns({f"w_{f}": written(f) for f in ALIASES})
    rules = lambda name: F.coalesce(F.col(f"_{name}.rules"), F.lit(0))

    def get(name: str) -> Column:
        token = F.col(f"w_{name}")
        return F.when(~F.lower(token).rlike(INFINITE), token)

    protocols = F.create_map(*[F.lit(x) for x in chain(*PROTOCOLS.items())])
    real = lambda name: get(name).try_cast("double")
    milliseconds = rules("flow_duration").bitwiseAND(RULES["milliseconds"]) > 0
    cast = {
        "flow_timestamp": F.try_to_timestamp(get("timestamp"), F.lit("dd/MM/yyyy HH:mm:ss")),
        "src_ip": _address(get("src_ip"), rules("src_ip")),
        "src_port": _whole(get("src_port"), rules("src_port")),
        "dst_ip": _address(get("dst_ip"), rules("dst_ip")),
        "dst_port": _whole(get("dst_port"), rules("dst_port")),
        "protocol": F.coalesce(F.when(rules("protocol").bitwiseAND(RULES["named"]) > 0, protocols[F.lower(get("protocol"))].cast("bigint")), _whole(get("protocol"), rules("protocol"))),
        "flow_duration": F.round(real("flow_duration") * F.when(milliseconds, 1000.0).otherwise(1.0), 3),
        "tot_fwd_pkts": _whole(get("tot_fwd_pkts"), rules("tot_fwd_pkts")),
        "tot_bwd_pkts": _whole(get("tot_bwd_pkts"), rules("tot_bwd_pkts")),
        "totlen_fwd_pkts": real("totlen_fwd_pkts"),
        "totlen_bwd_pkts": real("totlen_bwd_pkts"),
        "flow_byts_s": real("flow_byts_s"),
        "flow_pkts_s": real("flow_pkts_s"),
        "label": F.regexp_replace(get("label"), r"\s+", " "),
    }
    unit = F.when(milliseconds, "ms").otherwise("us")
    field = {"flow_timestamp": "timestamp"}
    lost = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(f"w_{field.get(n, n)}").isNotNull() & F.col(n).isNull(), F.struct(F.lit(n).alias("k"), F.col(f"w_{field.get(n, n)}").alias("v"))) for n in cast])))
    lines = lines.select("line_id", "feed", "source_file", "source_line", *[c.alias(n) for n, c in cast.items()], unit.alias("duration_unit"), *[f"w_{f}" for f in ALIASES], "_others", "fields")
    extra = F.map_from_entries(F.transform("_others", lambda x: F.struct(x["field"], F.get("fields", x["position"]))))
    return lines.select("line_id", "feed", "source_file", "source_line", *cast, "duration_unit", F.to_json(extra).alias("extra"), F.to_json(lost).alias("uncast"))
