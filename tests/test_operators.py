"""Operators on literal rows, rule by rule."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge import catalogue, schemas
from folioforge.functions import scores, text
from folioforge.operators import asr, fusion, htr, ocr, reasoning, retrieval
from folioforge.plans import engines, pipelines
from folioforge.sources import files, media, store
from folioforge.streaming import ingest


def one(spark, column, **values):
    """Value of a column expression over one row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("S. 138 and sec. 9", "Section 138 and Section 9"), ("cl. 4 Art. 14", "Clause 4 Article 14"), ("inter-\npretation", "interpretation"), ("a | b|c", "a b|c"), ("fl flow", "fi flow"), ("“x” ‘y’\x07", "\"x\" 'y'"), ("a\n\n\n\nb  c ", "a\n\nb c")],
)
def test_ocr_rules(spark, raw, want):
    assert one(spark, text.normalise_ocr(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("section 1 38", "Section 138"), ("section one thirty-eight", "Section 138"), ("section 12", "Section 12"), ("SECTION 12", "SECTION 12"), ("es see", "SC"), ("S.C. held", "S.C. held"), ("S.C.held", "SCheld"), ("the high court i p c", "the High Court IPC"), ("n.i. act r e r a", "NI Act RERA"), ("c r p c c p c", "CrPC CPC")],
)
def test_speech_rules(spark, raw, want):
    assert one(spark, text.correct_speech(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Section.138", "Section. 138"), ("Sec 5, s7", "Section 5, Section 7"), ("a.b.c", "a. b. c"), ("x—y", "x - y"), ("a \t b \n\n\n\nc", "a b\n\nc"), ("", ""), ("ﬁne ½", "fine 1⁄2")])
def test_fusion_rules(spark, raw, want):
    rows = spark.createDataFrame([(raw,)], "text string")
    assert fusion.nfkc(rows).select(text.clean_fused(F.col("text"))).first()[0] == want


def test_metadata(spark):
    got = one(spark, text.metadata(F.col("t")), t="AGREEMENT BETWEEN: Alpha Ltd\ndated 31/02/2020 and 5 March 2021 at Mumbai")
    assert (got["doc_type"], got["date"], got["jurisdiction"]) == ("contract", "2021-03-05", "Mumbai") and got["parties"][0].startswith("Alpha Ltd")
    assert one(spark, text.iso_date(F.col("t")), t="April 7, 2019") == "2019-04-07" and one(spark, text.iso_date(F.col("t")), t="none") is None
    assert one(spark, text.doc_type(F.col("t")), t="ORDER\nCOURT") is None and one(spark, text.doc_type(F.col("t")), t="Order of the Court") == "court_order"


@pytest.mark.parametrize(("raw", "speech", "fused"), [("Would it hold", "question", "narration"), ("attach it", "instruction", "narration"), ("draft it", "instruction", "instruction"), ("so?", "question", "question"), ("  ", "unknown", "unknown"), ("plain", "narration", "narration")])
def test_intent(spark, raw, speech, fused):
    assert one(spark, text.speech_intent(F.col("t")), t=raw) == speech
    assert one(spark, text.fused_intent(F.col("t")), t=raw) == fused
    assert one(spark, text.fused_intent(F.col("t"), F.lit("instruction")), t=raw) == "instruction"


def test_scores(spark):
    for lp, want in ((0.0, 100.0), (-1.0, 75.0), (-4.0, 0.0), (-9.0, 0.0), (1.0, 100.0)):
        assert one(spark, scores.logprob_confidence(F.col("x")), x=lp) == want
    assert one(spark, scores.review_required(F.col("x")), x=69.9) and not one(spark, scores.review_required(F.col("x")), x=70.0)
    assert one(spark, scores.mean_confidence(F.array(F.lit(-1.0), F.lit(80.0), F.lit(90.0)))) == 85.0 and one(spark, scores.mean_confidence(F.array(F.lit(-1.0)))) == 0.0
    assert one(spark, scores.handwriting_score(F.lit(5.0), F.lit(0.2), F.lit(255.0 * 255.0 / 4))) == 1.0
    assert one(spark, scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0)))) == 0.0
    v = one(spark, scores.hash_embedding(F.col("t")), t="é")
    assert len(v) == 128 and abs(sum(x * x for x in v) - 1) < 1e-12


def test_engine_tables(spark):
    assert [one(spark, ocr.paddle_language(F.col("x")), x=v) for v in ("mr", "pa", "xx")] == ["hi", "en", "en"]
    assert one(spark, ocr.tesseract_language(F.col("x")), x="en+hi+zz") == "eng+hin+eng"
    assert [one(spark, htr.engine_for(F.col("x")), x=v) for v in ("hi", "en")] == ["tesseract_devanagari", "trocr"]
    words = spark.sql("SELECT array(named_struct('corners', array(array(1D, 2D), array(5D, 2D), array(5D, 9D), array(1D, 9D)), 'text', 'a', 'confidence', 0.5D), named_struct('corners', array(array(0D, 0D)), 'text', ' ', 'confidence', 1D)) AS w")
    assert [tuple(r) for r in words.select(ocr.parse_paddle(F.col("w"))).first()[0]] == [("a", 50.0, 1.0, 2.0, 5.0, 9.0)]
    data = spark.sql("SELECT named_struct('text', array('a', '', 'b'), 'conf', array(90D, 5D, -1D), 'left', array(1D, 0D, 0D), 'top', array(2D, 0D, 0D), 'width', array(3D, 0D, 0D), 'height', array(4D, 0D, 0D)) AS d")
    assert [tuple(r) for r in data.select(ocr.parse_tesseract(F.col("d"))).first()[0]] == [("a", 90.0, 1.0, 2.0, 4.0, 6.0)]


def test_blocks_to_documents(spark):
    rows = [("d", 1, 1, "heading", " Title ", 60.0), ("d", 1, 2, "body", "S. 5 text", 70.0), ("d", 2, 1, "footer", "foot", 99.0), ("d", 2, 2, "body", " ", 99.0), ("e", 1, 1, "footer", "x", 10.0)]
    blocks = spark.createDataFrame(rows, "document_id string, page int, pos int, type string, text string, confidence double").withColumn("ocr_engine", F.lit("paddle"))
    got = {r["document_id"]: r for r in ocr.assemble(blocks).collect()}
    assert got["d"]["full_text"] == "Title\n\nSection 5 text" and got["d"]["low_confidence_pages"] == [1] and got["d"]["pages"] == 2
    assert got["e"]["full_text"] == "" and got["e"]["low_confidence_pages"] == [1]


def test_overlaps_keep_best(spark):
    boxes = "array(named_struct('x0', 0D, 'y0', 0D, 'x1', 10D, 'y1', 10D, 'score', 0.5D), named_struct('x0', 1D, 'y0', 0D, 'x1', 11D, 'y1', 10D, 'score', 0.9D), named_struct('x0', 50D, 'y0', 0D, 'x1', 60D, 'y1', 10D, 'score', 0.1D))"
    kept = spark.sql(f"SELECT {boxes} AS r").select(htr.suppress_overlaps(F.col("r"))).first()[0]
    assert [r["score"] for r in kept] == [0.9, 0.1]


def test_spelling(spark):
    words = spark.createDataFrame([("Contrct",), ("IPC",), ("teh",), ("138",), ("xyzzyx",), ("AGREEMNT",)], "word string")
    terms = spark.createDataFrame([("contract", 9), ("the", 99), ("agreement", 5), ("then", 1)], "term string, frequency int")
    got = {r["word"]: r["corrected"] for r in htr.correct_words(words, terms).collect()}
    assert got == {"Contrct": "Contract", "IPC": "IPC", "teh": "the", "138": "138", "xyzzyx": "xyzzyx", "AGREEMNT": "AGREEMNT"}  # capitals are preserved tokens
    assert {r["corrected"] for r in htr.correct_words(words, terms.where("frequency < 0")).collect()} == {w["word"] for w in words.collect()}
    rows = spark.createDataFrame([(1, "teh  contrct"), (2, "")], "region_id int, text string")
    assert {r["region_id"]: r["text"] for r in htr.spell_correct(rows, terms).collect()} == {1: "the contract", 2: ""}


def test_segments_to_transcript(spark):
    rows = [(1, "d", 0.6, -0.1, " high court "), (2, "d", 0.61, 0.0, "gone"), (3, "d", 0.0, -2.0, "low"), (4, "d", 0.0, 0.0, "  ")]
    segments = spark.createDataFrame(rows, "segment_id int, document_id string, no_speech_prob double, avg_logprob double, text string")
    got = asr.assemble_transcript(asr.process_segments(segments)).first()
    assert (got["transcript"], got["low_confidence_segments"], got["intent"]) == ("High Court [REVIEW]low[/REVIEW]", 1, "narration")


def test_fuse(spark):
    same = "The drawer shall pay the amount due."
    rows = [(1, "TYPED", same, "en", None), (1, "OCR", f"{same} More from print.", "en", None), (1, "ASR", "Was it paid [REVIEW]late[/REVIEW]", "hi", "instruction"), (2, "HTR", "a", "en", None), (2, "OCR", "kept. kept.", "fr", None)]
    blocks = spark.createDataFrame(rows, "document_id int, source string, text string, language string, intent string")
    got = {r["document_id"]: r for r in fusion.fuse(blocks).collect()}
    a = got[1]
    assert [m["source"] for m in a["modalities"]] == ["OCR", "ASR", "TYPED"] and a["modalities"][2]["text"] == ""
    assert a["fused_text"].startswith("[OCR-DOCUMENT]\n") and a["detected_intent"] == "instruction" and a["primary_language"] == "en"
    assert [tuple(f) for f in a["review_flags"]] == [("ASR", "late", "low_confidence")]
    assert got[2]["modalities"][0]["text"] == "kept. kept." and len(got[2]["modalities"]) == 1  # one block is not deduplicated
    texts = ["a b c d. A, b c d! ", "x y. a b c d."]
    assert fusion.keep_new_sentences(texts) == ["a b c d.", "x y."] and fusion.keep_new_sentences(texts, across_only=True) == ["a b c d. A, b c d!", "x y."]
    rag = one(spark, fusion.for_rag(F.col("t")), t=a["fused_text"])
    assert "[OCR" not in rag and "[REVIEW]late[/REVIEW]" in rag
    assert fusion.fuse(blocks).select(fusion.for_llm()).first()[0].startswith("[LEGAL-AI CONTEXT]\nLanguage: ")


def test_chunk_rules():
    body = " ".join(f"s{i} b c d e f g h i j." for i in range(30))
    made = retrieval.chunk_document(body, f"[OCR-DOCUMENT]\n{body}\n[/OCR-DOCUMENT]", retrieval.ChunkRules(50, 20, 5))
    assert [c[0] for c in made] == list(range(len(made))) and all(c[6] <= 50 for c in made)
    assert made[1][2].split(". ")[0] in made[0][2] and {c[1] for c in made} == {"OCR"}
    assert retrieval.chunk_document("few words.", "", retrieval.ChunkRules()) == [] and retrieval.chunk_document(" ", "", retrieval.ChunkRules()) == []
    fused = "[OCR-DOCUMENT]\nabc\n[/OCR-DOCUMENT]\n\n[ASR-VOICE]\nxyz\n[/ASR-VOICE]"
    at = fused.find("xyz")
    assert (retrieval.modality_at(fused, at, "reference"), retrieval.modality_at(fused, at, "interval")) == ("UNKNOWN", "ASR")


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((200, 16))
    entries = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(vectors)], "id int, seq int, embedding array<double>")
    asked = entries.where("id % 50 = 0").selectExpr("id AS query_id", "embedding")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for held in (1 << 20, 200):  # one block of queries, then several
        got = {}
        for r in retrieval.knn(entries, asked, 5, held).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == {q: np.lexsort((np.arange(200), -(unit @ unit[q])))[:5].tolist() for q in (0, 50, 100, 150)}
    near = retrieval.approximate_knn(entries, asked, 5, planes=3, tables=24).collect()
    exact = {(q, i) for q, ids in got.items() for i in ids}
    assert len({(r["query_id"], r["id"]) for r in near} & exact) >= 0.9 * len(exact)
    assert retrieval.knn(entries, asked.where("query_id < 0"), 5).collect() == []


def test_mmr():
    vectors = np.array([[1.0, 0], [1, 0.01], [0, 1]])
    relevance = np.array([0.9, 0.89, 0.5])
    assert retrieval.mmr_order(relevance, vectors, 2, 0.5) == [0, 2] and retrieval.mmr_order(relevance, vectors, 2, 1.0) == [0, 1] and retrieval.mmr_order(relevance, vectors, 3, 0.5) == [0, 1, 2]


def test_context_and_citations(spark):
    ranked = spark.createDataFrame([(1, 1, "OCR", 0.1235, "one\ntwo"), (1, 2, "ASR", None, "x")], "query_id int, position int, source_modality string, score double, text string")
    context = retrieval.context_string(ranked).first()["retrieval_context"]
    assert context == "[CONTEXT]\n\n[1] source=OCR score=0.123\none\ntwo\n\n[2] source=ASR score=n/a\nx\n\n[/CONTEXT]"
    asked = spark.createDataFrame([(1, "about a cheque", "", context, 1024), (2, "fraud", "", retrieval.NO_CONTEXT, 10)], "query_id int, query string, fused_document_text string, retrieval_context string, max_tokens int")
    answers, citations = reasoning.reason(asked)
    got = {r["query_id"]: r for r in answers.collect()}
    assert got[1]["is_grounded"] and not got[1]["review_required"] and got[2]["review_required"] and got[2]["answer_text"].endswith(".") and len(got[2]["answer_text"]) <= 41  # four characters a token, and the full stop
    cites = citations.collect()
    assert [(c["query_id"], c["chunk_id"], c["text_excerpt"]) for c in cites] == [(1, "ctx-chunk-1", "one two")]
    shown = {r["query_id"]: r for r in reasoning.format_answers(answers, citations).collect()}
    assert "[1] **OCR** (score: 0.123): _one two_" in shown[1]["markdown"] and "<ol>" in shown[1]["html"] and "Citations" not in shown[2]["markdown"]
    assert one(spark, text.strip_markers(F.col("t")), t="[REVIEW]a\nb[/REVIEW]  [UNCERTAIN] c") == "a\nb c"
    assert one(spark, text.escape_html(F.col("t")), t="<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"


def test_schemas_and_rules(spark):
    for ddl in (schemas.OCR_RESULT, schemas.HTR_RESULT, schemas.ASR_RESULT, schemas.FUSED_DOCUMENT, schemas.ENTRY, schemas.ANSWER, schemas.RESPONSE, schemas.TRANSCRIPTION, schemas.LEGAL_QUERY):
        assert schemas.parsed(ddl).fields
    boxes = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 1), (2.0, 0.0, 1.0, 1.0, 0), (None, 0.0, 1.0, 1.0, 1)], "x0 double, y0 double, x1 double, y1 double, page int")
    good, bad = schemas.split_rejects(boxes, schemas.box_rules())
    assert good.count() == 1 and sorted(len(r["errors"]) for r in bad.collect()) == [1, 2]


def test_store(spark, tmp_path):
    table = store.VectorTable(spark, str(tmp_path / "t"))
    assert table.count() == 0
    rows = lambda ids, v: spark.createDataFrame([(f"c{i}", v) for i in ids], "chunk_id string, version int")
    table.upsert(rows(range(4), 0), "a")
    table.upsert(rows((1, 9), 1), "a")
    table.upsert(rows((1,), 2), "b")
    assert (table.count("a"), table.count("b")) == (5, 1)
    ordered = [r["chunk_id"] for r in table.read("a").orderBy("seq").collect()]
    assert ordered[-2:] == ["c1", "c9"] and {r["version"] for r in table.get(rows((1, 77), 0), "a").collect()} == {1}
    table.delete_collection("a")
    assert (table.count("a"), table.count("b")) == (0, 1)


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x" * 10)
    (tmp_path / "b.exe").write_bytes(b"x")
    (tmp_path / "big.png").write_bytes(b"x" * 200)
    good, bad = files.scan(spark, str(tmp_path), files.DOCUMENT_EXTENSIONS, 100)
    assert [r["path"].rsplit("/", 1)[1] for r in good.collect()] == ["a.PDF"] and sorted(r["reason"][:3] for r in bad.collect()) == ["413", "415"]
    (tmp_path / "r.json").write_text('{"a": 1}\nnope\n{"a": 2}\n')
    good, bad = files.read_records(spark, str(tmp_path / "r.json"), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1


def test_media(spark, tmp_path):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.full(16000, 3276, "<i2").tobytes())
    (tmp_path / "a.wav").write_bytes(out.getvalue())
    (tmp_path / "b.wav").write_bytes(b"broken")
    got = {r["path"][-5:]: r for r in media.load_audio(files.audio(spark, str(tmp_path))[0]).collect()}
    assert got["a.wav"]["duration_s"] == 1.0 and abs(got["a.wav"]["samples"][0] - 0.1) < 1e-3 and got["b.wav"]["error"]
    assert (media.normalise_rms(np.full(10, 1e-8, np.float32)) == np.float32(1e-8)).all() and media.normalise_rms(np.full(10, 10.0, np.float32)).max() <= 1
    page = np.full((200, 300), 255, np.uint8)
    page[50:60, 40:200] = 0
    assert media.detect_layout(media.binarise(page)) == [(40, 50, 200, 60)] and media.skew_angle(page) == 0.0
    assert media.rotate(page, 0.05) is page and media.rotate(page, 90).shape[0] >= 299 and media.ensure_dpi(page, 75).shape == (400, 600)
    tilted = media.rotate(page, 5)
    assert abs(abs(media.skew_angle(tilted)) - 5) <= 0.5
    assert media.to_gray(np.zeros((2, 2, 3), np.uint8)).shape == (2, 2) and media.otsu(page) < 255


def test_engines(spark):
    engines.register("htr", "fixed", lambda: lambda values: [{"text": f"t{v}", "confidence": 88.0, "language": "en"} for v in values])
    rows = spark.range(3).select(engines.run("htr", "fixed", F.col("id")).alias("r"), engines.run("htr", "none", F.col("id")).alias("n")).orderBy("r.text").collect()
    assert [r["r"]["text"] for r in rows] == ["t0", "t1", "t2"] and rows[0]["n"]["confidence"] == 0.0 and "fixed" in engines.available("htr") and "none" not in engines.available("htr")


def test_streaming(spark, tmp_path):
    docs = [(i, f"[OCR-DOCUMENT]\n{'One two three four five six. ' * 30}{i}\n[/OCR-DOCUMENT]") for i in range(3)]
    schema = "document_id int, fused_text string"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "in"))
    table = store.VectorTable(spark, str(tmp_path / "t"))
    rules = retrieval.ChunkRules(60, 10, 5)
    for _ in range(2):  # a second start finds nothing new
        ingest.ingest_stream(spark, str(tmp_path / "in"), schema, table, str(tmp_path / "c"), rules=rules).awaitTermination()
    batch = pipelines.ingest(spark.createDataFrame(docs, schema), rules)
    assert table.count() == batch.count() > 3


def test_catalogue_names_agree():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) >= 45


def test_collections_stand_apart(spark, tmp_path):
    """An upsert touches its own collection, takes the last of repeated ids, and orders rows the same whatever their partitions."""
    rows = [(f"c{k}", f"d{k % 3}", k, f"t{k}", [float(k), 1.0]) for k in range(30)] + [("c5", "d2", 5, "u5", [9.0, 9.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string, embedding array<double>")
    orders = []
    for n in (1, 4):
        table = store.VectorTable(spark, str(tmp_path / f"t{n}"))
        table.upsert(chunks.repartition(n), "a/b")
        table.upsert(chunks.limit(3), "other")
        assert table.count("a/b") == 30 and table.count("other") == 3 and table.read().count() == 33
        assert table.get(spark.createDataFrame([("c5",)], "chunk_id string"), "a/b").first()["text"] == "u5"
        orders.append([r["chunk_id"] for r in table.read("a/b").orderBy("seq").collect()])
        for _ in range(3):
            table.upsert(chunks.where("chunk_id = 'c0'"), "a/b")
        assert [r["chunk_id"] for r in table.read("a/b").orderBy("seq").collect()][-1] == "c0"
        assert len(list((tmp_path / f"t{n}" / "c-a%2Fb").iterdir())) <= 2
        table.delete_collection("other")
        assert table.count("other") == 0 and table.count("a/b") == 30
    assert orders[0] == orders[1]


def test_knn_keeps_the_best_over_batches(spark):
    """Small Arrow batches, many ties, fewer entries than k: the same as sorting everything."""
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (300, 3)).astype(float)
    rows = [(k, k, v.tolist()) for k, v in enumerate(vectors)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        for n, k in ((300, 5), (3, 5), (300, 1)):
            entries = spark.createDataFrame(rows[:n], "id long, seq long, embedding array<double>").repartition(2)
            queries = spark.createDataFrame([(q, vectors[q].tolist()) for q in range(0, 300, 50)], "query_id long, embedding array<double>")
            got = retrieval.knn(entries, queries, k).withColumn("score", F.round("score", 9))
            unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
            for q in range(0, 300, 50):
                want = np.sort(np.round(unit[:n] @ unit[q], 9))[::-1][:k]
                assert np.allclose([r["score"] for r in got.where(F.col("query_id") == q).orderBy("rank").collect()], want, atol=1e-8)
    finally:
        spark.conf.set(key, before)


def test_approximate_neighbours_write_no_pairs(spark, monkeypatch):
    """The best among entries of a common code, as plain loops find them, with exact copies and a repeated id; no pair or vector is shuffled."""
    monkeypatch.setattr(retrieval, "PAIRS", 50)
    rng = np.random.default_rng(5)
    vectors = np.concatenate([np.repeat(rng.standard_normal((40, 8)), 9, axis=0), rng.standard_normal((40, 8)), np.zeros((1, 8))])
    ids = rng.permutation(len(vectors)).tolist()
    ids[0] = ids[1]
    rows = [(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)]
    planes, tables, seed = 3, 4, 7
    normals = np.random.default_rng(seed).standard_normal((tables * planes, 8))
    codes = [tuple(tuple((v @ normals.T > 0)[t * planes : (t + 1) * planes]) for t in range(tables)) for v in vectors]
    want = {}
    for q, a, x in zip(ids, codes, vectors, strict=True):
        if q % 50 == 0 and q != ids[0]:
            score = {i: round(float(x @ y) / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-300), 9) for i, b, y in zip(ids, codes, vectors, strict=True) if any(s == t for s, t in zip(a, b, strict=True))}
            want[q] = sorted(score, key=lambda i: (-score[i], i))[:5]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "37")
    try:
        for kind, held in (("int", 1 << 20), ("long", 300)):  # one block of queries, then several
            entries = spark.createDataFrame(rows, f"id {kind}, embedding array<double>").repartition(3)
            asked = entries.where("id % 50 = 0").selectExpr("id AS query_id", "embedding").where(F.col("query_id") != ids[0])
            near = retrieval.approximate_knn(entries, asked, 5, planes, tables, seed, held)
            got = {}
            for r in near.orderBy("rank").collect():
                got.setdefault(r["query_id"], []).append(r["id"])
            assert got == want
            plan = near._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Generate" not in plan
        named = entries.selectExpr("'n' || lpad(id, 4, '0') AS id", "embedding")
        got = {}
        for r in retrieval.approximate_knn(named, asked, 5, planes, tables, seed).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(int(r["id"][1:]))
        assert got == want
    finally:
        spark.conf.set(key, before)
    assert retrieval.approximate_knn(entries, asked.where("query_id < 0"), 5).collect() == [] and retrieval.approximate_knn(entries.where("id < 0"), asked, 5).collect() == []


def test_recall_over_copies(spark, tmp_path):
    """Exact copies tie in both searches by id, whatever a matrix product rounds; the query neither writes pairs nor loses recall by ties."""
    from folioforge import catalogue

    rng = np.random.default_rng(6)
    vectors = np.tile(rng.standard_normal((101, 64)).astype(np.float32), (40, 1))
    rows = [(i, v.tolist(), i % 10) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    entries, asked = catalogue._entries(spark, str(tmp_path)), catalogue._questions(spark, str(tmp_path))
    got = {}
    for r in retrieval.knn(entries, asked, 5).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {q: [q % 101 + 101 * k for k in range(5)] for q in range(0, len(rows), 50)}
    recall = catalogue.queries()["ann_recall"](spark, str(tmp_path))
    assert tuple(recall.first()) == (81, True) and "Generate" not in recall._jdf.queryExecution().optimizedPlan().toString()


def test_searches_write_no_more_for_more_splits(spark):
    """Entries of 100 splits: both searches run in few tasks, as each writes its best k of every query, and find what one task finds."""
    rng = np.random.default_rng(8)
    rows = [(i, i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 8)))]
    entries = spark.createDataFrame(rows, "id long, seq long, embedding array<double>")
    asked = entries.where("id % 50 = 0").selectExpr("id AS query_id", "embedding")
    most = max(retrieval.SEARCHERS, 2 * spark.sparkContext.defaultParallelism)
    for search in (lambda e: retrieval.knn(e, asked, 5), lambda e: retrieval.approximate_knn(e, asked, 5, 3, 4)):
        near = search(entries.repartition(100))
        searched = near._jdf.queryExecution().optimizedPlan().toString().partition("MapInArrow")[2]
        assert f"Repartition {most}, false" in searched.splitlines()[1]
        got, want = (f.select("query_id", "rank", "id").orderBy("query_id", "rank").collect() for f in (near, search(entries.coalesce(1))))
        assert got == want and len(got) > 50


def test_whole_mean_confidence_in_any_order(spark):
    """Values whose mean is exactly 75: floor gives 75 however rows are ordered and dealt; NaN, huge, negative and null values as before."""
    cents = [160 * 5 * i + 7 * j for i in range(1, 10) for j in (-11, 11, -3, 3)]
    logs = [-(c / 100) / 40 for c in cents]
    shift = sum(16000 - c for c in cents)  # hundredths of percent times 160
    assert shift % (160 * len(cents)) == 0 and shift // (160 * len(cents)) == 75
    floors = set()
    for seed in range(40):
        order = np.random.default_rng(seed).permutation(len(logs))
        rows = spark.createDataFrame([(logs[i],) for i in order], "x double").coalesce(1 + seed % 2)
        floors.add(rows.agg(F.floor(scores.mean_confidence_agg(scores.logprob_confidence(F.col("x"))))).first()[0])
    assert floors == {75}
    mean = lambda values: spark.createDataFrame([(v,) for v in values], "x double").agg(scores.mean_confidence_agg(F.col("x"))).first()[0]
    assert mean([-1.0, 80.0, None, 90.0]) == 85.0 and mean([-1.0, None]) == 0.0 and mean([]) == 0.0 and mean([1e300, 1.0]) == 5e299
    assert np.isnan(mean([float("nan"), 1.0])) and mean([float("inf"), 1.0]) == float("inf") and abs(mean([0.1, 0.2, 0.4]) - 0.7 / 3) < 1e-12
