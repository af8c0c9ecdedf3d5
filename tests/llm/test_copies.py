from autuario.llm.copies import copies, copy_counts, copy_key

SCHEMA = "id string, t string, key int, kept int"
D, J = "Dispositivos relevantes citados: CC, art. 1.", "Jurisprudência relevante citada: STJ, REsp 1."


def test_key():
    assert copy_key(f"Texto. {D} {J}") == copy_key(f"TEXTO {J}\r\n{D}")
    assert copy_key(f"Texto. {D}") != copy_key(f"Texto. {J}")
    assert copy_key("ação") != copy_key("acao") and copy_key(None) is None and copy_key(" —\r\n") is None


def groups(rows):
    by = {}
    for i, t, *_ in rows:
        if i is not None and copy_key(t):
            by.setdefault(copy_key(t), set()).add(i)
    return sorted(((min(v), x) for v in by.values() for x in v if x != min(v)), key=str)


def test_copies_and_counts(spark, rows):
    data = [(f"h{k:04}", "Hot  TEXT." if k % 2 else "hot text", 0, 0) for k in range(500)] + [(f"u{k}", f"texto {k} " + "x" * 3000, 0, 0) for k in range(50)]
    data += [("a", f"T {D} {J}", 0, 0), ("b", f"T {J} {D}", 0, 0), ("b", f"T {J} {D}", 0, 0), ("n", None, 0, 0), ("e", "", 0, 0), ("p", "...", 0, 0), (None, "hot text", 0, 0), ("h0003", "texto 7 " + "x" * 3000, 0, 0)]
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    assert rows(copies(df, "id", "t")) == groups(data)
    counts = dict(rows(copy_counts(df, "id", "t")))
    assert counts["h0000"] == 500 and counts["a"] == 2 and counts["n"] == 1 and counts["u9"] == 1
    assert rows(copies(df.limit(0), "id", "t")) == [] and rows(copy_counts(df.limit(0), "id", "t")) == []
