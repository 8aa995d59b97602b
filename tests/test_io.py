"""Readers, writers, pipeline, streaming and the registry of queries."""

import datetime as dt
import json
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandmill import sinks, sources
from strandmill.gates import GateError, fingerprint
from strandmill.operators import votes as vo
from strandmill.plans.pipeline import Frozen, Pipeline, golden, same_twice
from strandmill.sinks.reports import evidence_sentences
from strandmill.sources.registry import SourceRegistry, load_card, resolve_parameters, sha256_of
from strandmill.streaming import current, intake

ROOT = Path(__file__).resolve().parent.parent


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_tsv(spark, tmp_path):
    p = put(tmp_path / "a.tsv", 'id\tname\n1\t"x\n2\t\n')
    assert [tuple(r) for r in sources.tsv(spark, p, ["id"]).collect()] == [("1", '"x'), ("2", "")]
    assert sources.table_header(spark, p) == ["id", "name"]
    with pytest.raises(GateError):
        sources.tsv(spark, p, ["missing"])


def test_csv_charset(spark, tmp_path):
    text = 'Index,Name\n1,"肠道\n菌群"\n2,"a ""b"""\n'
    p = put(tmp_path / "a.csv", text, "gb18030")
    assert [r.Name for r in sources.csv_with_charset(spark, p, ["Index"]).collect()] == ["肠道\n菌群", 'a "b"']
    q = put(tmp_path / "b.csv", text, "gb18030")
    assert sources.csv_with_charset(spark, q, charset="utf-8", fallback="gb18030").first().Name == "肠道\n菌群"


def test_json_lines(spark, tmp_path):
    a = put(tmp_path / "a.jsonl", json.dumps({"pmid": "1", "annotations": [{"type": "d", "id": "mesh:D1"}]}) + "\n" + json.dumps({"pmid": "2", "annotations": []}) + "\n")
    assert [r.pmid for r in sources.articles(spark, a, ["MESH:D1"]).collect()] == ["1"]
    line = lambda s, v: json.dumps({"pmid": "1", "sentence": s, "predicate": "p", "votes": [v]})
    one = put(tmp_path / "1.jsonl", line("s", "old") + "\nnot json\n" + line("t", "x") + "\n")
    two = put(tmp_path / "2.jsonl", line("s", "new") + "\n")
    got = {r.sentence: r.votes for r in sources.vote_lines(spark, [one, two]).collect()}
    assert got == {"s": ["new"], "t": ["x"]}


def test_dumps_matrices_and_xml(spark, tmp_path):
    n = put(tmp_path / "names.dmp", "1\t|\tAll\t|\t\t|\tscientific name\t|\n")
    assert tuple(sources.ncbi_names(spark, n).first()) == ("1", "All", "", "scientific name")
    assert tuple(sources.ncbi_nodes(spark, put(tmp_path / "nodes.dmp", "2\t|\t1\t|\tgenus\t|\n")).first()) == ("2", "1", "genus")
    m = put(tmp_path / "m.tsv", "feature\ts1\ts2|x\nf\t1\tNA\ng\t\t2.5\nf\t3\t0\n")
    got = sorted((r.feature, r["sample"], r.value) for r in sources.long_matrix(spark, m, "c").collect())
    assert got == [("f", "s1", 3.0), ("f", "s2|x", 0.0), ("g", "s1", 0.0), ("g", "s2|x", 2.5)]
    assert sorted(r["sample"] for r in sources.header_ids(spark, m, stratified=True).collect()) == ["s1", "s2"]
    ln = put(tmp_path / "l.tsv", "#c\nk__A|s__B_c\t1\nk__A\t2\n")
    assert [r.lineage for r in sources.lineages(spark, ln, "x").collect()] == ["k__A|s__B_c"]
    fl = put(tmp_path / "f.tsv", "feature\tfamily\nk|g__Some_genus\tgenus\nplain\tother\n")
    assert sorted(tuple(r) for r in sources.feature_list(spark, fl).collect()) == [("", "plain", "other"), ("g__", "Some genus", "genus")]
    assert sources.feature_list(spark, str(tmp_path / "none.tsv")).count() == 0
    x = put(tmp_path / "d.xml", "<Set><DescriptorRecord><DescriptorUI>D1</DescriptorUI><TreeNumberList><TreeNumber>C1</TreeNumber><TreeNumber>C1.2</TreeNumber></TreeNumberList></DescriptorRecord><DescriptorRecord><DescriptorUI>D2</DescriptorUI></DescriptorRecord></Set>")
    assert sorted(((r.id, r.path) for r in sources.mesh_trees(spark, x).collect()), key=repr) == [("D1", "C1"), ("D1", "C1.2"), ("D2", None)]


def test_registry_and_parameters(tmp_path):
    put(tmp_path / "a.txt", "x")
    put(tmp_path / "reg.json", json.dumps({"ok": {"path": "a.txt", "sha256": sha256_of(tmp_path / "a.txt")}, "bad": {"path": "a.txt", "sha256": "0"}, "gone": {"path": "b.txt"}}))
    reg = SourceRegistry.load(tmp_path / "reg.json")
    assert reg.resolve("ok").name == "a.txt"
    for name in ("bad", "gone", "unknown"):
        with pytest.raises(GateError):
            reg.resolve(name)
    assert resolve_parameters({"a": None, "b": 1}, {"a": 2}, {"a": 3, "c": 4}) == {"a": 2, "b": 1, "c": 4}
    with pytest.raises(GateError):
        load_card(tmp_path / "reg.json", ("needed",))


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.25, ["x", "y"]), ("a", None, [])], "k string, v double, l array<string>").withColumn("extra", F.lit(1))
    first = sinks.write_tsv(df, tmp_path / "o.tsv", ["k", "v", "l"], ["k"])
    assert (tmp_path / "o.tsv").read_text() == "k\tv\tl\na\t\t\nb\t0.25\tx;y\n"
    assert sinks.write_tsv(df.repartition(3), tmp_path / "o2.tsv", ["k", "v", "l"], ["k"]) == first
    assert sinks.append_only(df, tmp_path / "n.tsv", ["k"], ["k"]) == "written" and sinks.append_only(df, tmp_path / "n.tsv", ["k"], ["k"]) == "unchanged"
    with pytest.raises(GateError):
        sinks.append_only(df.limit(1), tmp_path / "n.tsv", ["k"], ["k"])
    old = (tmp_path / "n.tsv").read_bytes()
    assert sinks.prefix_append(df.unionByName(df.withColumn("k", F.lit("c"))), tmp_path / "n.tsv", ["k"], ["k"]) == 2
    assert (tmp_path / "n.tsv").read_bytes().startswith(old) and not (tmp_path / "n.tsv.part").exists()
    with pytest.raises(GateError):
        sinks.prefix_append(df, tmp_path / "n.tsv", ["k", "v"], ["k"])
    sinks.manifest(tmp_path / "m.json", b=1, a=2)
    assert list(json.loads((tmp_path / "m.json").read_text())) == ["a", "b"]
    assert "o.tsv" in sinks.checksums(tmp_path) and "SHA256SUMS" not in sinks.checksums(tmp_path)
    with pytest.raises(GateError):
        sinks.empty_dir(tmp_path)
    assert sinks.copy_verified(tmp_path / "o.tsv", tmp_path / "x" / "o.tsv") == first


def test_reports_and_delivery(spark, tmp_path):
    cards = spark.createDataFrame([(f"C{i}", "m", "b", "g", "p", f"E{i}", 3 + i % 2, 0.5, i, 1.0, 0.0) for i in range(12)], "chain_id string, microbe_id string, metabolite_id string, gene_id string, pathway string, hop1_edge_id string, votes_total int, evidence_score double, borda long, verified_rate double, penalty double")
    a = spark.createDataFrame([("E11", str(p), f"s{p}") for p in range(5)] + [("E11", "9", None)], "edge_id string, pmid string, sentence string")
    assert evidence_sentences(cards, a).count() == 3
    top = vo.top_cards(cards)
    sums = sinks.delivery_pack(tmp_path / "pack", cards, top, a)
    assert set(sums) == {"README.md", "manifest.json", "top.tsv", "top10.md"}
    with pytest.raises(GateError):
        sinks.delivery_pack(tmp_path / "pack2", cards, top.limit(9), a)
    page = sinks.html_report("<t>", top, ["rank", "chain_id"])
    assert "&lt;t&gt;" in page and page.count("<tr>") == 11
    assert "na" in sinks.markdown_report("t", {"rows": [{"a": None}], "none": [], "facts": {"x": None}})
    assert "not a finding" in sinks.explain_chain(top.first().asDict())


def test_pipeline_resumes(spark, tmp_path):
    calls = []

    def double(s, t):
        calls.append("double")
        return t["in"].withColumn("v", F.col("v") * 2)

    def total(s, t):
        calls.append("total")
        return t["double"].agg(F.sum("v").alias("v"))

    data = spark.createDataFrame([(1,), (2,)], "v long")
    p = Pipeline(tmp_path / "run", [("double", double), ("total", total)])
    assert p.run(spark, {"in": data})["total"].first().v == 6
    p.run(spark, {"in": data}, resume=True)
    assert calls == ["double", "total"] and p.ran == []
    p.run(spark, {"in": data}, first="total")
    assert calls == ["double", "total", "total"]
    p.run(spark, {"in": data}, dry_run=True)
    assert p.ran == ["double", "total"] and len(calls) == 3
    more = spark.createDataFrame([(100,)], "v long")
    assert p.run(spark, {"in": more}, resume=True)["total"].first().v == 200 and p.ran == ["double", "total"]  # another input runs anew
    triple = Pipeline(tmp_path / "run", [("double", lambda s, t: t["in"].withColumn("v", F.col("v") * 3)), ("total", total)])
    assert triple.run(spark, {"in": more}, resume=True)["total"].first().v == 300  # and so does another step
    written = []
    Pipeline(tmp_path / "out", [("double", double)], outputs={"double": lambda df: written.append(df.count())}).run(spark, {"in": data})
    assert written == [2]
    assert same_twice(tmp_path / "twice", spark, [("double", double), ("total", total)], {"in": data}) == {"double": True, "total": True}
    with pytest.raises(GateError):
        p.run(spark, {"in": data}, first="nope")
    with Frozen({"in": data}):
        pass
    assert golden({"a": data}, {"a": fingerprint(data), "b": "x"}) == {"a": True, "b": False}


def test_streaming_intake(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda i, o, p: json.dumps({"assertion_id": i, "subject": "A", "predicate": "p", "object": o, "pmid": p, "polarity": "positive", "confidence": 0.5, "status": "ok", "seen_at": "2025-01-01T00:00:00Z"})
    put(src / "1.json", "\n".join([row("1", "B", "10"), row("1", "B", "10"), row("2", "C", "11")]))
    args = (spark, str(src), str(tmp_path / "edges"), str(tmp_path / "cp"))
    intake(*args).awaitTermination()
    put(src / "2.json", row("3", "B", "12") + "\n" + row("2", "C", "11"))
    intake(*args).awaitTermination()
    got = {r.object: (sorted(r.pmids), r.support_count) for r in current(spark, str(tmp_path / "edges")).collect()}
    assert got == {"B": (["10", "12"], 2), "C": (["11"], 1)}
    uri = (tmp_path / "edges").as_uri()  # another name of the same folder keeps the history
    put(src / "3.json", row("4", "D", "13"))
    intake(spark, str(src), uri, str(tmp_path / "cp")).awaitTermination()
    assert {r.object for r in current(spark, uri).collect()} == {"B", "C", "D"}


def test_queries_are_named_once_and_have_oracles():
    import __spark_entry__ as entry

    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 85
    without = {q for q in qs if q not in sql}
    assert all(re.match("p[0-9]", q) for q in without - {"degree_matched_arms"}), without


def test_core_works_without_the_llm_subpackage(tmp_path):
    import shutil

    for part in ("strandmill", "__spark_entry__.py"):
        s = ROOT / part
        (shutil.copytree if s.is_dir() else shutil.copyfile)(s, tmp_path / part)
    shutil.rmtree(tmp_path / "strandmill" / "llm", ignore_errors=True)  # it may be gone already
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p6_ids' not in q; assert not set(e.oracle_sql()) - set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path), "JAVA_HOME": __import__("os").environ.get("JAVA_HOME", "")})
    for p in (ROOT / "strandmill").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "strandmill").parts:
            assert "strandmill.llm" not in p.read_text(), p


def test_core_works_where_a_package_of_llm_is_missing(tmp_path):
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p6_ids' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(ROOT), "JAVA_HOME": __import__("os").environ.get("JAVA_HOME", "")})


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from strandmill.session import shared_dir

    unset = SimpleNamespace(get=lambda *a: None)
    fake = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master=master, applicationId=f"test-{master}"))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            shared_dir(fake(master))
    assert shared_dir(fake("local[4]")).startswith("file://")


def test_session_is_utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.createDataFrame([(dt.datetime(2025, 1, 1),)], "t timestamp").first().t == dt.datetime(2025, 1, 1)
