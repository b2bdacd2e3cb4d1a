from pyspark.sql import functions as F
from test_csv_rejects import RAW, classes

from siltstream.operators import schema_drift as S

TS = "03/07/2029 01:21:53"


def raw(spark, files):
    rows, n = [], 0
    for seq, (name, lines) in enumerate(files, 1):
        for i, line in enumerate(lines, 1):
            n += 1
            rows.append((n, "feed", name, seq, None, i, 0, line))
    return spark.createDataFrame(rows, RAW)


FILES = [
    ("f1", ["Timestamp,Src IP,Src Port,Label,Ttl Min", f"{TS},1.2.3.4,80,Benign,5", f"{TS},nan,81,Benign,"]),
    ("f2", ["Label,Timestamp,SrcAddr,Src Port,ttl_min", f"Benign,{TS},16909060,80.0,NA", f"bad,{TS},x,y,z"]),
    ("f3", ["Label,Timestamp,Src Port,Zone", f"Benign,{TS},0xFF,north"]),
    ("f4", ["Label,Timestamp,Src Port,Zone", f"Benign,{TS},,inf"]),
]


def test_changes(spark):
    got = {tuple(r) for r in S.schema_changes(raw(spark, FILES), classes(spark)).collect()}
    assert got == {
        ("f2", "renamed", "SrcAddr"),
        ("f2", "type_changed", "SrcAddr"),
        ("f2", "type_changed", "Src Port"),
        ("f2", "renamed", "ttl_min"),
        ("f3", "removed", "SrcAddr"),
        ("f3", "removed", "ttl_min"),
        ("f3", "added", "Zone"),
        ("f3", "type_changed", "Src Port"),
    }


def test_versions_and_table(spark):
    data = raw(spark, FILES).withColumn("field", F.lit("clash"))
    versions = {r.source_file: (r.version, r.steps) for r in S.schema_versions(data, classes(spark)).collect()}
    assert [versions[f][0] for f, _ in FILES] == [1, 2, 3, 4]
    assert versions["f1"][1] == "" and "rename Src IP to SrcAddr" in versions["f2"][1] and "cast src_ip text to integer" in versions["f2"][1]
    rows = {(r.source_file, r.source_line): r for r in S.consistent_table(data, classes(spark)).collect()}
    assert rows["f1", 2].src_ip == rows["f2", 2].src_ip == "1.2.3.4"
    assert (rows["f1", 2].src_port, rows["f2", 2].src_port, rows["f3", 2].src_port, rows["f4", 2].src_port) == (80, 80, 255, None)
    assert rows["f3", 2].src_ip is None and rows["f3", 2].extra == '{"zone":"north"}' and rows["f1", 3].src_ip is None
    assert ("f2", 3) not in rows


def test_empty_and_unknown_names(spark):
    empty = spark.createDataFrame([], RAW)
    assert S.schema_changes(empty, classes(spark)).count() == 0 and S.consistent_table(empty, classes(spark)).count() == 0
    names = ["DestinationAddress", "destination ip", "Vlan Tag", "vlan_tag", "Flow Bytes/s"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(S.canonical(F.col("n"))).collect()]
    assert got == ["dst_ip", "dst_ip", "vlan_tag", "vlan_tag", "flow_byts_s"]


def test_ports_and_durations_in_all_forms(spark):
    head = "Label,Timestamp,Src Port,Flow Duration,Flow Byts/s"
    files = [
        ("us", [head, f"Benign,{TS},p34323,334310,1.5", f"Benign,{TS},tcp/23894,907.0,Infinity", f"Benign,{TS},eighty,12us,NaN", f"Benign,{TS},80.5,,"]),
        ("ms", [head.replace("Flow Duration", "FlowDur"), f"Benign,{TS},TCP/80,107.075,2", f"Benign,{TS},P81,155,null"]),
    ]
    rows = {(r.source_file, r.source_line): r for r in S.consistent_table(raw(spark, files), classes(spark)).collect()}
    assert [rows["us", i].src_port for i in (2, 3, 4, 5)] == [34323, 23894, None, None]
    assert [rows["ms", i].src_port for i in (2, 3)] == [80, 81]
    assert [rows["us", i].flow_duration for i in (2, 3, 4)] == [334310.0, 907.0, None]
    assert [(rows["ms", i].flow_duration, rows["ms", i].duration_unit) for i in (2, 3)] == [(107075.0, "ms"), (155000.0, "ms")]
    assert rows["us", 2].uncast == rows["ms", 3].uncast == "{}" and rows["us", 3].uncast == '{"flow_byts_s":"Infinity"}'
    assert rows["us", 4].uncast == '{"src_port":"eighty","flow_duration":"12us"}' and rows["us", 5].uncast == '{"src_port":"80.5"}'


def test_routes_chain_the_steps(spark):
    files = [
        ("f1", ["Label,Timestamp,Src Port,Vlan Tag,Ip Ttl", f"Benign,{TS},80,7,64"]),
        ("f2", ["Label,Timestamp,SPort,vlan_tag", f"Benign,{TS},0x51,8"]),
        ("f3", ["Label,Timestamp,SPort,vlan_tag", f"Benign,{TS},0x52,9"]),
        ("f4", ["Label,Timestamp,Origin Port,VLAN-Tag,ip_ttl", f"Benign,{TS},tcp/83,10,x"]),
    ]
    data = raw(spark, files)
    versions = {r.source_file: r for r in S.schema_versions(data, classes(spark)).collect()}
    assert [versions[f].version for f, _ in files] == [1, 2, 2, 3] and versions["f2"].fingerprint == versions["f3"].fingerprint
    routes = {(r.version, r.field): (r.position, r.target_name, r.rules) for r in S.migration_routes(data, classes(spark)).collect()}
    assert {v for v, _ in routes} == {1, 2, 3} and len(routes) == 15
    assert routes[1, "src_port"] == (2, "Origin Port", "rename") and routes[2, "src_port"] == (2, "Origin Port", "rename; cast hexadecimal")
    assert routes[3, "src_port"] == (2, "Origin Port", "cast prefixed") and routes[2, "ip_ttl"] == (None, "ip_ttl", "default")
    assert routes[1, "vlan_tag"] == (3, "VLAN-Tag", "rename") and routes[1, "label"] == (0, "Label", "")
    rows = {r.source_file: r for r in S.consistent_table(data, classes(spark)).where("source_line = 2").collect()}
    assert [rows[f].src_port for f, _ in files] == [80, 81, 82, 83]
    assert [rows[f].extra for f, _ in files] == ['{"vlan_tag":"7","ip_ttl":"64"}', '{"vlan_tag":"8"}', '{"vlan_tag":"9"}', '{"vlan_tag":"10","ip_ttl":"x"}']


def test_a_new_order_is_no_new_version_but_read_in_its_own_order(spark):
    files = [("f1", ["Label,Timestamp,Src Port,Zone", f"Benign,{TS},80,north"]), ("f2", ["Zone,Src Port,Timestamp,Label", f"south,81,{TS},Benign"])]
    data = raw(spark, files)
    assert {r.version for r in S.schema_versions(data, classes(spark)).collect()} == {1}
    rows = {r.source_file: r for r in S.consistent_table(data, classes(spark)).collect()}
    assert [(rows[f].src_port, rows[f].extra, rows[f].label) for f in ("f1", "f2")] == [(80, '{"zone":"north"}', "Benign"), (81, '{"zone":"south"}', "Benign")]
