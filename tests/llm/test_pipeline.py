"""Every stage of the pipeline against a plain version, on what the stage before kept."""

import corpus_pipeline as P
from tessera.llm import importance, secret_scan
from tessera.session import stage

from .test_decontaminate import plain_leaks
from .test_near_copies import plain_groups


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out, columns = [docs], docs.columns
    for name, fn in P.STAGES:
        out.append(stage(fn(spark, out[-1], d), "test"))
        assert out[-1].columns[:len(columns)] == columns and (name == "mixing sources" or out[-1].columns == columns)
    rows = [{r.doc_id: r for r in df.collect()} for df in out]

    kept = {r.doc_id for r in importance.resampled(docs, labels).collect() if r.kept}
    assert set(rows[1]) == kept and 0.7 * len(rows[0]) < len(kept) < len(rows[0])
    groups = plain_groups({i: r.text for i, r in rows[1].items()})
    assert set(rows[2]) == set(groups.values()) and len(rows[2]) < len(rows[1])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    leaked = {i for i, _ in plain_leaks([(i, r.text) for i, r in rows[2].items()], items)}
    assert leaked and set(rows[3]) == set(rows[2]) - leaked
    assert set(rows[4]) == set(rows[3])
    assert any(secret_scan.scan(r.text.encode()) for r in rows[3].values())
    for i, r in rows[4].items():
        assert secret_scan.scan(r.text.encode()) == [] and r.n_chars == (len(r.text) if r.text != rows[3][i].text else rows[3][i].n_chars)
        assert r.text == secret_scan.masked(rows[3][i].text)
    assert set(rows[5]) <= set(rows[4]) and all(0 < r.taken <= 2 * r.size or r.size == 0 for r in rows[5].values())
    by_source = {}
    for r in rows[5].values():
        by_source.setdefault(r.source, []).append(r)
    for g in by_source.values():
        assert abs(sum(r.taken for r in g) - g[0].target) <= max(r.size for r in g)
    again = {tuple(r) for r in P.run(spark, d).collect()}
    assert again == {tuple(r) for r in rows[5].values()}


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
