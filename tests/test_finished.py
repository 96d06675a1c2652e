"""Documents that become whole on a stream, over batches and restarts, equal to one batch of all pages."""

from folioflow.streaming import finished


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), finished.PAGES).coalesce(1)


def page(doc, n_pages, page_no, units=2, open_=0):
    return (doc, n_pages, page_no, units, units - open_, 0, open_, 1)


def test_over_batches_and_a_restart(spark, tmp_path):
    inbox, results, state = (str(tmp_path / k) for k in ("in", "out", "state"))
    batches = [
        [page("a", 3, 1), page("b", 2, 1, 2, 1), page("c", 1, 1, 0)],
        [page("a", 3, 2), page("a", 3, 1), page("d", 2, 2)],
        [page("a", 3, 3), page("b", 2, 2), page("c", 1, 1, 0), (None, 1, 1, 1, 1, 0, 0, 0)],
    ]
    go = lambda: finished.start(spark, inbox, results, state, files_per_batch=1).awaitTermination()
    found = []
    for rows in batches:  # each start is a restart
        pages(spark, *rows).write.mode("append").parquet(inbox)
        go()
        found.append({r["doc_key"] for r in spark.read.schema(finished.DOCUMENTS).parquet(results).collect()})
    assert found == [{"c"}, {"c"}, {"a", "b", "c"}]
    go()  # nothing new
    out = sorted((tuple(r) for r in spark.read.schema(finished.DOCUMENTS).parquet(results).collect()), key=repr)
    assert [r[:2] for r in out] == [("a", 3), ("b", 2), ("c", 1)]
    batch = finished.documents_of(pages(spark, *[r for rows in batches for r in rows if r[0]]))
    assert out == sorted((tuple(r) for r in batch.collect()), key=repr)
    assert {r[0]: r[-1] for r in out} == {"a": "concluido", "b": "concluido_com_pendencias", "c": "concluido_com_pendencias"}


def test_page_totals(spark):
    flag = "array<struct<code:string,message:string>>"
    known = spark.createDataFrame([("d", 1), ("d", 2), ("d", 2)], "doc_key string, page_no int")
    rows = spark.createDataFrame([("d", 1, "traduzido", [("x", "y")]), ("d", 1, "preservado", []), ("d", 1, "falhou", [])], f"doc_key string, page_no int, state string, flags {flag}")
    found = sorted(tuple(r) for r in finished.page_totals(known, rows).collect())
    assert found == [("d", 2, 1, 3, 1, 1, 1, 1), ("d", 2, 2, 0, 0, 0, 0, 0)]
    done = finished.documents_of(finished.page_totals(known, rows)).first()
    assert (done["empty_pages"], done["state"]) == ([2], "concluido_com_pendencias")
    assert finished.documents_of(finished.page_totals(known, rows).limit(1)).isEmpty()
