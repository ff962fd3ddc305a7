"""Texts, ids and tables chosen to break the corpus operators."""

import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from folioforge.llm import blocks, decontaminate, lines, neardup, packing, quality, staging
from tests.llm.test_documents import brute_contamination, shingles

LEAST, MOST = -(2**63), 2**63 - 1
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DDL)


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def twisted(n):
    """Two texts of n letters that every polynomial hash modulo a power of two confuses from 1,024 letters on."""
    one = thue_morse(n)
    return one, one.translate(str.maketrans("ab", "ba"))


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, 5000, n))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_hashes_tell_twisted_texts_apart(n):
    a, b = twisted(n)
    words = [a, b, a, b[:-1], a[:-1], b + "a", a + "\0", a + "\0\0", "", "x"]
    block = next(blocks.text_blocks(pa.array(words)))
    for seed in (blocks.SEED, blocks.OTHER_SEED):
        h = blocks.range_hashes(block.data, block.offsets[:-1], block.offsets[1:], seed).tolist()
        assert h[0] == h[2] and len(set(h)) == len(h) - 1
    assert blocks.same_ranges(block.data, block.offsets[:-1], block.offsets[1:], np.array([0, 1, 0, 3, 4, 5, 6, 7, 8, 9]))
    for k in (1, 4, 6, 8):
        assert not blocks.same_ranges(block.data, block.offsets[:-1], block.offsets[1:], np.array([k, 1, 0, 3, 4, 5, 6, 7, 8, 9]))


def test_hashes_depend_on_bytes_alone():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 9, 16, 17, 4096, 4097, 5000):
        body = rng.integers(0, 256, n).astype(np.uint8)
        seen = set()
        for lead in range(9):
            data = np.concatenate([rng.integers(0, 256, lead).astype(np.uint8), body, rng.integers(0, 256, 5).astype(np.uint8)])
            seen.add(int(blocks.range_hashes(data, np.array([lead]), np.array([lead + n]))[0]))
        assert len(seen) == 1


def test_twisted_lines_stay_and_twisted_words_do_not_link(spark):
    a, b = twisted(1024)
    texts = [(1, f"{a}\nsecond\nthird"), (2, f"{b}\nsecond\nthird"), (3, f"{a}\nsecond\nthird")]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(frame(spark, texts)).collect()}
    assert got == {1: 0, 2: 0, 3: 3}
    rows = [(1, f"{a} one two three four"), (2, f"{b} one two three four"), (3, f"{a} one two three four")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_ids_at_both_ends(spark):
    base = prose(1, 200)
    rows = [(MOST - k, f"{base} tail{k}") for k in range(5)] + [(LEAST + k, f"{prose(2, 200)} tail{k}") for k in range(5)] + [(0, prose(3, 50))]
    docs = frame(spark, rows)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    for k in range(5):
        assert got[MOST - k] == (MOST - 4, k == 4) and got[LEAST + k] == (LEAST, k == 0)
    assert got[0] == (0, True)
    assert {r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()} == {MOST - 4, LEAST, 0}
    assert sum(r["n_removed"] for r in lines.dedup_lines(docs.unionByName(docs)).collect()) == 0
    assert len(packing.pack_documents(docs).collect()) >= len(rows)


def test_repeated_ids_keep_every_link(spark):
    t, u = prose(4, 200), prose(5, 200)
    rows = [(1, t), (1, u), (2, t + " x"), (3, u + " x"), (4, prose(6, 80)), (4, prose(7, 80)), (4, prose(6, 80)), (None, t), (None, "zz")]
    for order in (rows, rows[::-1]):
        docs = frame(spark, order)
        got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(docs).collect())
        assert got == [(0, 0, True)] * 2 + [(1, 1, True)] * 2 + [(2, 1, False), (3, 1, False)] + [(4, 4, True)] * 3
        kept = sorted((r["doc_id"] or 0, r["text"]) for r in neardup.drop_near_duplicates(docs).collect())
        assert kept == sorted((i or 0, x) for i, x in rows if i not in (2, 3))


def test_a_row_goes_without_its_namesake(spark):
    t = prose(8, 200)
    rows = [(1, t), (2, t + " x"), (2, prose(9, 60)), (2, ""), (2, None)]
    kept = {(r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == {rows[0], *rows[2:]}


def plain_quality(text):
    """The clean text, or None for a rejected one, rule by rule; for ASCII texts."""
    if text is None:
        return None
    w = text.split()
    runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    repeated = {j for k, run in enumerate(runs) if runs.count(run) > 1 for j in range(k, k + 5)}
    if len(w) < 10 or 100 * len(repeated) > 20 * len(w):
        return None
    kept = []
    for line in text.split("\n"):
        v, n = line.split(), len(line.split())
        marks = sum(x in quality.NAVIGATION_MARKS for x in v)
        bad = marks >= 3 and 5 * marks >= n
        bad |= n > 2 and 10 * len(re.findall(r"[#*$%&|<>]", line)) >= 3 * n
        bad |= n > 2 and 10 * sum(x.endswith("!!") for x in v) >= 3 * n
        bad |= n >= 8 and not any(re.search(r"[.!?:;][\"')\]}*_]*$", x) for x in v)
        bad |= any(phrase in line.lower() for phrase in quality.BOILERPLATE)
        if not (n and bad):
            kept.append(line)
    return "\n".join(kept) if 2 * sum(len(x.split()) for x in kept) >= len(w) else None


def plain_pipeline(rows, items):
    """(doc_id, text) of what the first four stages keep, each stage by itself in plain Python; ids of rows may repeat."""
    docs = [(i, plain_quality(t)) for i, t in rows]
    docs = [(i, t) for i, t in docs if t is not None]
    left = brute_lines(docs, True)
    docs = [(i, left[i, t]) for i, t in docs if left[i, t] == t or left[i, t].strip()]
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if None not in (docs[a][0], docs[b][0]) and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min(docs[k][0] for k in range(len(docs)) if group[k] == g and docs[k][0] is not None) for g in group if docs[g][0] is not None}
    docs = [d for d, g in zip(docs, group) if d[0] is None or d[0] == least[g]]
    return [(i, t) for i, t in docs if not brute_contamination(t, items)[4]]


def brute_lines(rows, beside_long):
    """(doc_id, text) to the text left, window by window, over distinct documents in their order."""
    stamp = {}
    docs = sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, later = {}, {r: set() for r in docs}
    for r in docs:
        body = (r[1] or "").split("\n")
        solid = [k for k, x in enumerate(body) if re.search("[^\x20\x09-\x0d]", x)]
        n = {k: len(re.findall("[^\x20\x09-\x0d]+", body[k])) for k in solid}
        for p in range(len(solid)):
            for span in (1, 2, 3):
                at = solid[p : p + span]
                if len(at) < span or span < 3 and sum(n[k] for k in at) < 50 or span == 2 and not beside_long and max(n[k] for k in at) >= 50:
                    continue
                if first.setdefault((span, tuple(body[k] for k in at)), (r, at[0])) != (r, at[0]):
                    later[r].update(range(at[0], at[-1] + 1))
        stamp[r] = body
    return {r: "\n".join(x for k, x in enumerate(stamp[r]) if k not in later[r]) for r in docs}


@pytest.mark.parametrize("beside_long", [False, True])
def test_lines_match_brute_force(spark, beside_long):
    rng = np.random.default_rng(11)
    pool = ["", " ", "\t", "a", "b b", "c c c", "dd", "é", *(prose(k, 30) for k in range(3)), *(prose(k, 55) for k in range(3, 6))]
    rows = [(int(k) if k else None, "\n".join(rng.choice(pool, rng.integers(1, 12)))) for k in range(60)]
    rows += [(70, None), (71, None), (72, ""), (5, rows[5][1]), (73, rows[9][1])]
    docs = frame(spark, rows)
    got = lines.dedup_lines(docs, beside_long=beside_long).collect()
    want = brute_lines([r for r in rows if r[1] is not None], beside_long)
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["text"])
    for (i, _), text in want.items():
        assert text in by_id[i]
    assert by_id[70] == by_id[71] == {None} and by_id[72] == {""}


def test_a_passage_of_many_items_and_documents(spark, monkeypatch):
    """No text or list of items travels with a document: what is scanned and joined stays small."""
    passage = prose(20, 60)
    items = [(k, f"{prose(1000 + k, 30)} {passage} {prose(2000 + k, 30)}") for k in range(300)] + [(7, "again the same id " + prose(21, 20)), (None, passage)]
    texts = [(k, f"{prose(3000 + k, 20)} {passage} {prose(4000 + k, 20)}") for k in range(400)] + [(500, prose(1003, 30)), (501, items[9][1]), (502, passage), (502, "clean"), (None, passage), (503, prose(21, 20))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    scanned, hits, members = decontaminate._judged(frame(spark, texts), benchmark, 1 << 20)
    assert hits.count() <= len(texts) and max(len(r["classes"]) for r in hits.collect()) <= 3
    assert members.count() < 5000
    got = decontaminate.find_contamination(frame(spark, texts), benchmark).collect()
    known = [(str(i) if i is not None else "", t) for i, t in items]
    want = sorted((i if i is not None else -1, *brute_contamination(t, known)) for i, t in texts)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *tuple(r)[1:]) for r in got) == want


def test_a_word_that_is_an_item_stands_everywhere(spark):
    texts = [(1, "the " * 50_000), (2, "a the b"), (3, "then"), (4, "the cat sat on the mat " * 2000)]
    items = [(1, "The"), (2, "the cat sat"), (3, "sat on the mat the")]
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.find_contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: brute_contamination(t, items) for i, t in texts}


def test_encoder_forgets_and_stays_right(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "_RING_IDS", 1 << 9)
    monkeypatch.setattr(packing, "_SLOTS", 1 << 4)
    monkeypatch.setattr(packing, "_SLOT_SHIFT", np.uint64(60))
    encoder, plain = packing.Encoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    rng = np.random.default_rng(5)
    for _ in range(60):
        texts = [" ".join(rng.choice(["to", "tothe", "éa", "日本", "x" * 300, "q1", "<|endoftext|>", "", "\\n"], rng.integers(0, 60))) for _ in range(8)]
        block = next(blocks.text_blocks(pa.array(texts)))
        ids, bounds = encoder.encode(block)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def write_tables(spark, folder, rows, items):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.select("doc_id", "text"))
    return seen


def test_pipeline_matches_plain_stages(spark, tmp_path):
    rng = np.random.default_rng(17)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 900, n)) + "."
    shared = [say(12) for _ in range(5)]
    items = [(k, say(40)) for k in range(4)] + [(9, None), (None, "")]
    rows = []
    for k in range(40):
        body = [say(int(rng.integers(9, 30))) for _ in range(int(rng.integers(2, 9)))]
        extra = rng.random()
        if extra < 0.2:
            body[1:1] = shared[:3]
        elif extra < 0.35:
            body.append("home | about | news | contact")
        elif extra < 0.5:
            body.append(items[k % 4][1])
        elif extra < 0.6:
            body = [body[0]] * 6
        elif extra < 0.75 and rows:
            body = (rows[int(rng.integers(0, len(rows)))][1] or "").replace("w7", "w8").split("\n")
        rows.append((k, "\n".join(body)))
    long = say(300)
    rows += [(50, long), (51, long[:-1] + " more."), (50, say(40)), (None, long), (None, say(30)), (52, None), (53, ""), (3, rows[3][1]), (54, rows[5][1])]
    write_tables(spark, tmp_path, rows, items)
    want = sorted(((i is not None, i or 0), t) for i, t in plain_pipeline(rows, items))
    got = [r for r in stages(spark, str(tmp_path))[-1].collect()]
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"]) for r in got) == want
    packed = corpus_pipeline.run(spark, str(tmp_path)).where("piece = 0").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in packed) == [w[0] for w in want]


def test_pipeline_of_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path / "a", [], [(1, "a b c")])
    assert [x.count() for x in stages(spark, str(tmp_path / "a"))] == [0] * 4
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).collect() == []
    write_tables(spark, tmp_path / "b", [(1, prose(1, 40) + "."), (2, None)], [])
    assert [x.count() for x in stages(spark, str(tmp_path / "b"))] == [1] * 4


def test_a_cluster_must_name_its_folder():
    class Session:
        conf = {}

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match=r"checkpoint\.dir"):
        staging.shared_folder(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://shared/checkpoints"
    assert staging.shared_folder(Session()) == "hdfs://shared/checkpoints"
