"""Flow layouts, trace files, machine files and stored tables on small generated files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowloom.functions.scalar import label_class
from flowloom.operators import machine as M, normalise as N, symbolic as Y
from flowloom.sources import flows as S, machines as D, store, traces as X


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


BI_HEADER = "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label\n"


def test_bidirectional(spark, tmp_path):
    path = write(tmp_path, "bi.csv", BI_HEADER + (
        "2011/08/10 09:46:53.047277,3550.18,udp,212.50.71.179,39678,<->,147.32.84.229,13363,CON,0,0,12,875,413,flow=Background-UDP\n"
        "2011/08/10 09:46:53.1,0.5,icmp,fe80::1,0x0303,->,147.32.84.59,,,0,,2,100,60,flow=From-Botnet-V42\n"
        "2011/08/10 09:46:54.000001,1,newproto,147.32.84.1,,->,147.32.84.2,80,S_,0,0,1,10,4\n"
        "2011/08/10 09:46:55.000001,1,tcp,147.32.84.1,1,->,147.32.84.2,80,S_,0,0,1,10,4,flow=From-Normal,too,many\n"))
    kept, rejects = S.read_flows(spark, path, "ctu_bi")
    flows = N.canonical_flows(kept.withColumn("flow_id", F.monotonically_increasing_id()), "ctu_bi")
    rows = {r.src_ip: r for r in flows.collect()}
    assert len(rows) == 3 and [r.line.count("too") for r in rejects.collect()] == [1]
    first = rows["212.50.71.179"]
    assert (first.src_port, first.dst_port, first.dst_bytes, first.protocol_num, first.label) == (39678, 13363, 462, 0, 0)
    assert first.date == dt.datetime(2011, 8, 10, 9, 46, 53, 47277) and first.duration == 3550.18
    hexed = rows["fe80::1"]
    assert (hexed.src_port, hexed.dst_port, hexed.protocol_num, hexed.label) == (0x303, -1, 2, 1)
    assert hexed.date_us % 1_000_000 == 100_000
    short = rows["147.32.84.1"]  # one field short: the label is missing, the line stays
    assert short.src_port == -1 and short.protocol_num == -1 and short.detailed_label is None


def test_unidirectional_text_and_csv(spark, tmp_path):
    text = write(tmp_path, "uni.txt", (
        "Date flow start Durat Prot Src IP Addr:Port Dst IP Addr:Port Flags Tos Packets Bytes Flows Label\n"
        "2011-08-16 14:18:55.889\t2.0 TCP 147.32.86.166:33426 -> 212.24.150.110:25443 FRPA_ 0 44 10043 1 Background\n"
        "2011-08-16 14:18:55.9\t1.0 ICMP 147.32.86.166 -> 2001:db8::7:443 INT 0 2 120 1 Botnet\n"
        "2011-08-16 14:18:56.25\t1.0 IGMP 10.0.0.1:x -> 10.0.0.2 INT 0 2 120 1 LEGITIMATE\n"))
    rows = sorted(S.read_netflow_text(spark, text).collect(), key=lambda r: r.date)
    assert [r.src_ip for r in rows] == ["147.32.86.166", "147.32.86.166", "10.0.0.1"]
    assert [r.src_port for r in rows] == [33426, None, None]
    assert (rows[1].dst_ip, rows[1].dst_port, rows[1].label) == ("2001:db8::7", 443, "Botnet")
    csv = write(tmp_path, "uni.csv", "h\n2011-08-16 14:18:55.889000,2.0,TCP,a,1,b,,FR,0,44,10043,1,LEGITIMATE\n"
                "2011-08-16 14:18:56.000000,2.0,UDP,a,1,b,5,FR,0,4,13,1,Botnet\n")
    kept, _ = S.read_flows(spark, csv, "ctu_uni")
    flows = N.canonical_flows(kept.withColumn("flow_id", F.monotonically_increasing_id()), "ctu_uni").orderBy("flow_id").collect()
    assert [(r.dst_port, r.src_bytes, r.protocol_num, r.label) for r in flows] == [(-1, 10043, 0, 0), (5, 13, 1, 1)]


def test_unsw(spark, tmp_path):
    def line(**at):
        values = {0: "59.166.0.0", 1: "1390", 2: "149.171.126.6", 3: "53", 4: "udp", 5: "CON", 6: "0.001055", 7: "132", 8: "164",
                  11: "0", 12: "0", 13: "dns", 16: "2", 17: "2", 28: "1421927414", 29: "1421927415", 47: "", 48: "0", **at}
        return ",".join(values.get(i, "0") for i in range(49)) + "\n"

    path = write(tmp_path, "u.csv", line() + line(**{}) .replace("1390", "0x20").replace("dns", "-") + line().replace(",,0\n", ",Fuzzers,1\n").replace("udp", "sctp"))
    kept, _ = S.read_flows(spark, path, "unsw")
    kept = kept.withColumn("flow_id", F.monotonically_increasing_id())
    flows = N.canonical_flows(kept, "unsw").orderBy("flow_id").collect()
    assert [r.src_port for r in flows] == [1390, 32, 1390]
    assert [r.label for r in flows] == [0, 0, 1] and [r.protocol_num for r in flows] == [0, 0, 1]
    assert [r.detailed_label for r in flows] == ["missing", "missing", "Fuzzers"]
    assert flows[0].date == dt.datetime(2015, 1, 22, 11, 50, 14)
    assert kept.filter("service is null").count() == 1


def test_cicids(spark, tmp_path):
    def line(date, proto, label, port="80"):
        values = {1: "192.168.10.5", 2: "1", 3: "8.8.8.8", 4: port, 5: proto, 6: date, 7: "3", 8: "1", 9: "1", 10: "12", 11: "6", 84: label}
        return ",".join(values.get(i, "x") for i in range(85)) + "\n"

    path = write(tmp_path, "c.csv", "header\n" + line("13/7/2017 8:59", "6", "BENIGN") + line("07/07/2017 03:30:05", "17", "Web Attack \x96 XSS")
                 + line("7/7/2017 3:30", "200", "DoS") + line("7/7/2017 3:30", "6", "DoS", port=""), "latin-1")
    kept, _ = S.read_flows(spark, path, "cicids")
    flows = N.canonical_flows(kept.withColumn("flow_id", F.monotonically_increasing_id()), "cicids").orderBy("flow_id").collect()
    assert [r.protocol for r in flows] == ["TCP", "UDP", "proto_200"]  # the row without a port is dropped
    assert flows[0].date == dt.datetime(2017, 7, 13, 8, 59) and flows[1].date == dt.datetime(2017, 7, 7, 3, 30, 5)
    assert [r.label for r in flows] == [0, 1, 1] and flows[1].detailed_label == "Web Attack \x96 XSS"


def test_label_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, "flow=From-Botnet"), (2, "flow=From-Normal"), (3, "flow=Background")], "date_us long, label string")
    path = str(tmp_path / "store")
    S.write_label_store(rows.withColumn("label_class", label_class("ctu_bi")), path)
    both = S.read_label_store(spark, path)
    assert sorted(r.date_us for r in both.collect()) == [1, 2]
    assert "PartitionFilters: [label_class" in both._jdf.queryExecution().toString()


def test_limits_dictionary_and_results(spark, tmp_path):
    flows = spark.createDataFrame([(i, ["b", "a", "c"][i % 3], float(i)) for i in range(9)], "flow_id long, protocol string, v double")
    path = str(tmp_path / "dict")
    first = {r.value: r.code for r in store.load_dictionary(spark, path, flows, "protocol").collect()}
    again = {r.value: r.code for r in store.load_dictionary(spark, path, flows.filter("flow_id > 5"), "protocol").collect()}
    assert first == again == {"b": 0, "a": 1, "c": 2}
    store.write_limits(M.fit_limits(flows, ["v"], []), str(tmp_path / "limits"))
    assert M.read_limits(store.load_limits(spark, str(tmp_path / "limits"))) == {"v": ("numeric", [2.0, 4.0, 6.0])}
    out = str(tmp_path / "results")
    for name in ("a", "b", "a"):
        store.write_results(spark.createDataFrame([(name, "e", 1)], "test_set string, entity string, tp long"), out)
    assert store.load_results(spark, out).count() == 2
    assert [r.entity for r in store.load_results(spark, out, ["b"]).collect()] == ["e"]


def test_trace_files(spark, tmp_path):
    rows = [("10.0.0.1", t, p, p * 3 + t, 0.5 * p) for t in range(3) for p in range(4)]
    traced = spark.createDataFrame(rows, "entity string, trace_id long, pos long, a long, b double")
    lines = X.trace_lines(traced, ["a", "b"], ints=False)
    assert sorted(r.line for r in lines.collect())[0] == "1 4 0:0.0,0.0 0:3.0,0.5 0:6.0,1.0 0:9.0,1.5"
    X.write_traces(lines, X.trace_headers(lines, 2), str(tmp_path / "t"))
    read = X.read_traces(spark, str(tmp_path / "t")).collect()
    assert sorted((r.pos, *r.attrs) for r in read) == sorted((p, float(a), b) for _, _, p, a, b in rows)
    single = write(tmp_path, "scenario3-10.0.0.1-8.8.8.8-traces.txt", "2 100:2\n1 2 0:1,2 0:3,4\n1 1 0:5,6\n")
    parsed = X.read_trace_files(spark, single).collect()
    assert {r.entity for r in parsed} == {"10.0.0.1-8.8.8.8"} and sorted(r.attrs for r in parsed) == [[1, 2], [3, 4], [5, 6]]
    symbolic = write(tmp_path, "s-10.0.0.1-traces.txt", "2 12\n1 3 4 5 4\n1 1 7\n")
    parsed = X.read_trace_files(spark, symbolic, symbolic=True).collect()
    assert sorted(r.symbol for r in parsed) == ["4", "4", "5", "7"] and {r.entity for r in parsed} == {"10.0.0.1"}


MACHINE = """digraph DFA {
\tI [ label="root" ];
\t\tI -> 0;
\t0 [ label="fin(0):3 symb(0):5,
 attr(0):[1,2,3,4,] attr(1):[4,3,2,1,]" style=filled];
\t\t0 -> 1 [label="0 <= 10 1 > 2.5" ];
\t\t0 -> 1 [label="0 == 99 " ];
\t\t0 -> 2 [label="0 > 10 0 < 99" ];
\t1 [ label="fin(0):0 symb(0):2, attr(0):[0,1,0,1,]" ];
\t\t1 -> 3 [label="" ];
\t2 [ label="fin(0):1 symb(0):0," ];
\t3 [ label="fin(0):1 symb(0):1," ];
\t\t3 -> 3;
}
"""


@pytest.fixture
def machine(spark, tmp_path):
    text = MACHINE.replace('I [ label="root" ]', '9 [ label="root" ]')
    return D.read_state_models(spark, write(tmp_path, "m-10.0.0.1_dfa.dot", text))


def test_state_machine_file(machine):
    states, bins, transitions = machine
    assert {r.state: (r.fin, r.total) for r in states.collect()} == {
        "root": (0, 0), "0": (3, 8), "1": (0, 2), "2": (1, 1), "3": (1, 2)}
    assert {(r.state, r.attr): r.counts for r in bins.collect()} == {
        ("0", "0"): [1, 2, 3, 4], ("0", "1"): [4, 3, 2, 1], ("1", "0"): [0, 1, 0, 1]}
    edges = {(r.src, r.dst): [[tuple(c) for c in clause] for clause in r.clauses] for r in transitions.collect()}
    assert edges["0", "1"] == [[(0, "<=", 10.0), (1, ">", 2.5)], [(0, "==", 99.0)]]
    assert edges["0", "2"] == [[(0, ">", 10.0), (0, "<", 99.0)]]
    assert edges["root", "0"] == [[]] and edges["1", "3"] == [[]]


def test_numbers_and_unread_conditions(spark):
    label = lambda text: spark.createDataFrame([("m", f'digraph G {{\n0 -> 1 [color="red" label="{text}"];\n}}\n')], "model_id string, value string")
    read = lambda text: [tuple(c) for c in D.parse_state_models(label(text))[2].first().clauses[0]]
    assert read("0 <= -1.5 1 > 1e-05 2 < 2E+06 3 == .5 4 >= 7") == [
        (0, "<=", -1.5), (1, ">", 1e-05), (2, "<", 2e6), (3, "==", 0.5), (4, ">=", 7.0)]
    for text in ("0 <= x", "0 < 1.2.3", "a > 4"):
        with pytest.raises(Exception, match="unread condition"):
            read(text)


def test_replay_of_a_read_machine(spark, machine):
    traces = {
        0: [[5.0, 3.0], [1.0, 1.0], [0.0, 0.0]],  # 0 -> 1 -> 3 without further tests
        1: [[99.0, 0.0], [1.0, 1.0]],  # second alternative of the guard
        2: [[50.0, 0.0], [1.0, 1.0], [2.0, 2.0]],  # 2 has no successor: stay
        3: [[5.0, 1.0], [1.0, 1.0]],  # no guard holds: an error
    }
    rows = [("m-10.0.0.1_dfa", "e", t, [(p, a) for p, a in enumerate(records)]) for t, records in traces.items()]
    packed = spark.createDataFrame(
        rows, "model_id string, entity string, trace_id long, records array<struct<pos:long,attrs:array<double>>>")
    visits = M.replay_machines(packed, machine[2])
    got = {}
    for r in visits.orderBy("pos").collect():
        got.setdefault(r.trace_id, []).append(r.state)
    assert got == {0: ["0", "1", "3"], 1: ["0", "1"], 2: ["0", "2", "2"], 3: ["0", None]}
    assert [(r.trace_id, r.pos) for r in M.replay_errors(visits).collect()] == [(3, 1)]


SYMBOLIC = """digraph {
0 -> 1 [label="5:3 7:1"  ];
0 -> 2 [label="6:2" style=dotted  ];
1 -> 1 [label="5:4"  ];
}
"""


def test_symbolic_machine_file(spark, tmp_path):
    edges = D.read_symbolic_models(spark, write(tmp_path, "s.dot", SYMBOLIC))
    assert {(r.src, r.symbol): (r.dst, r.cnt) for r in edges.collect()} == {
        ("0", "5"): ("1", 3), ("0", "7"): ("1", 1), ("0", "6"): ("2", 2), ("1", "5"): ("1", 4)}
    probs = {(r.src, r.symbol): round(r.prob, 6) for r in Y.laplace_edges(edges).collect()}
    assert probs[("0", "5")] == round(4 / 9, 6) and probs[("0", "unseen")] == round(1 / 9, 6)
    traces = lambda *symbols: spark.createDataFrame(
        [("s", "e", i, list(s)) for i, s in enumerate(symbols)], "model_id string, entity string, trace_id long, symbols array<string>")
    test = traces("55", "65", "5", "8")  # state 2 has no edges and rejects
    assert Y.acceptance(test, edges).first().accepted == 0.5
    error = Y.pattern_error(traces("55", "7"), test, edges).first().error
    # train: (1,5) 2/3, (1,7) 1/3; test: (1,5) 3/4, (2,6) 1/4
    assert abs(error - (abs(2 / 3 - 3 / 4) + 1 / 3 + 1 / 4) / 3) < 1e-12
