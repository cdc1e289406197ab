"""Review verdicts, dictionary growth, verification and table changes."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.operators import lexicon as lex_ops, review, tables, terms
from hydromelt.plans import dictionary as plans, mapping
from hydromelt.sources import dictionaries


def test_apply_review_grows_the_dictionary(spark, dictionary_dir, tmp_path):
    queue = tmp_path / "queue.csv"
    queue.write_text("\n".join([
        ",".join(C.QUEUE_COLUMNS), "OPR_NM,odd.xlsx,,,MD-301,박", "전기전도도값,a.csv,WQ-102,90.9,승인,박", "전기 전도도값,b.csv,WQ-102,90.9,ok,김",
        "염분,a.csv,WQ-106,,y,", "버림,a.csv,WQ-102,,기각,", "모름,a.csv,,,승인,", "없음코드,a.csv,,,ZZ-1,", "빈칸,a.csv,WQ-102,,,"]) + "\n",
        encoding="utf-8-sig")
    out = str(tmp_path / "out")
    log = plans.apply_review(spark, str(queue), dictionary_dir, out, datetime(2026, 8, 8, 19, 22, 36))
    rows = sorted((r.code, r.synonym, r.dict_file, r.reviewer, r.collected_at) for r in log.collect())
    assert rows == [("MD-301", "OPR_NM", "metadata_terms.csv", "박", "2026-08-08T19:22:36"),
                    ("WQ-102", "전기전도도값", "measurement_terms.csv", "박", "2026-08-08T19:22:36")]
    plans.apply_review(spark, str(queue), dictionary_dir, out, datetime(2026, 8, 8, 19, 22, 36))
    assert spark.read.option("header", True).csv(f"{out}/review_log.csv").count() == 2
    grown = spark.read.option("header", True).csv(f"{out}/metadata_terms.csv")
    assert "강이름|OPR_NM" in [r.synonyms for r in grown.collect()]
    flat = [dictionaries.read_flat_terms(spark, f"{out}/{name}/*.csv") for name in C.DICT_FILES.values()]
    row = mapping.matching.map_names(spark.createDataFrame([("OPR_NM",)], "raw string"), lex_ops.build_lexicon(*flat)).first()
    assert (row.status, row.code) == ("exact", "MD-301")


def test_skipped_verdicts_are_told(spark):
    queue = spark.createDataFrame([("a", "", "승인"), ("b", "", "ZZ-1"), ("c", "WQ-1", "x"), ("d", "WQ-1", "승인")],
                                  "`원본명` string, `후보 표준코드` string, `사람판정` string")
    known = spark.createDataFrame([("WQ-1",)], "code string")
    got = {r["원본명"]: r.reason for r in review.skipped_verdicts(queue, known).collect()}
    assert got == {"a": "candidate missing", "b": "code unknown"}


def test_growth_between_two_dictionaries(spark, samples, dictionary_dir, tmp_path):
    from pathlib import Path
    grown = tmp_path / "grown"
    grown.mkdir()
    for name in C.DICT_FILES.values():
        text = (Path(dictionary_dir) / name).read_text(encoding="utf-8-sig")
        (grown / name).write_text(text.replace("강이름", "강이름|OPR_NM"), encoding="utf-8-sig")
    got = {r.filename: (float(r.rate_1), float(r.rate_2)) for r in mapping.growth(
        spark, samples, dictionary_dir, str(grown)).collect()}
    assert got["odd_names.xlsx"] == (60.0, 80.0)


def test_version_and_hash(spark, dictionary_dir, tmp_path):
    import hashlib
    import json
    from pathlib import Path
    paths = dictionaries.dictionary_paths(dictionary_dir)
    want = hashlib.sha256(b"".join(Path(p).read_bytes() for p in paths)).hexdigest()[:16]
    assert dictionaries.dictionary_hash(spark, *paths) == want
    assert not dictionaries.is_stale(spark, want, *paths) and dictionaries.is_stale(spark, "0" * 16, *paths)
    flat = [dictionaries.read_flat_terms(spark, p) for p in paths]
    stamp = plans.version_stamp(*flat, want, date(2026, 8, 8), note="n")
    assert stamp["version"] == "dict-2026-08-08" and stamp["counts"] == {
        "measurement_terms": 5, "metadata_terms": 4, "synonyms": 12, "verified_terms": 8}
    (tmp_path / "VERSION.json").write_text(json.dumps(stamp))
    assert plans.load_version(spark, str(tmp_path / "VERSION.json"))["content_hash"] == want


def test_flat_file_needs_a_code_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name_ko\na\n")
    with pytest.raises(dictionaries.HeaderNotFound):
        dictionaries.read_flat_terms(spark, str(tmp_path / "x.csv"))


def _tables(spark):
    measurement = spark.createDataFrame([(0, "WQ-001", "총질소", "Total Nitrogen", "T-N", "verified"),
                                         (1, "WQ-002", "총인", "Total Phosphorus", "-", "draft"),
                                         (2, "WQ-003", "버림", "", "", "rejected")],
                                        "row_no int, code string, std_name string, name_en string, abbr string, review_status string")
    metadata = spark.createDataFrame([(0, "MD-001", "측정소명", "", "", "verified")],
                                     "row_no int, code string, std_name string, name_en string, abbr string, review_status string")
    rows = [(0, "WQ-001", "", "TN", "a"), (1, "WQ-001", "", "총 질소(total nitrogen)", "a"), (2, "WQ-001", "", "TN", "b"),
            (3, "WQ-002", "", "총인(total phosphorus)", "a"), (4, "WQ-002", "", "TP(총인함량)", "b"), (5, "WQ-002", "", "총인함량", "a"),
            (6, "", "MD-001", "지점명", "ai")]
    synonyms = spark.createDataFrame([(*r, "verified") for r in rows], "row_no int, measurement_code string, metadata_code string, "
                                     "surface string, source_id string, review_status string")
    sources = spark.createDataFrame([("a", "observed"), ("b", "legal"), ("ai", "inferred")], "source_id string, reliability string")
    return measurement, metadata, synonyms, sources


def test_export_drops_redundant_spellings(spark):
    flat = plans.export_flat(*_tables(spark), exclude_inferred=True)
    got = {r.code: r for df in flat for r in df.collect()}
    assert set(got) == {"WQ-001", "WQ-002", "MD-001"}
    # 'TN' repeats the key of 'T-N'; the spelled-out name repeats the standard name.
    assert (got["WQ-001"].synonyms, got["WQ-001"].synonym_count, got["WQ-001"].source_count) == ("", 3, 2)
    assert (got["WQ-002"].synonyms, got["WQ-002"].abbr, got["WQ-002"].verified) == ("TP(총인함량)", "", "N")
    assert (got["MD-001"].synonyms, got["MD-001"].synonym_count) == ("", 0)


def test_import_review_log(spark):
    _, _, synonyms, sources = _tables(spark)
    log = spark.createDataFrame([(0, "WQ-001", "새 이름", "2026-08-08T19:22:36", "f.csv", "박"), (1, "WQ-001", "새_이름", "x", "g", ""),
                                 (2, "WQ-001", "t_n", "x", "g", ""), (3, "", "y", "x", "g", "")],
                                "row_no int, code string, synonym string, collected_at string, source string, reviewer string")
    grown, known = plans.import_review_log(log, synonyms, sources)
    added = grown.where("source_id = 'HUMAN_REVIEW'").collect()
    assert [(r.measurement_code, r.surface) for r in added] == [("WQ-001", "새 이름")]
    assert known.where("source_id = 'HUMAN_REVIEW'").count() == 1
    again, known = plans.import_review_log(log, grown, known)
    assert again.count() == grown.count() and known.where("source_id = 'HUMAN_REVIEW'").count() == 1


def test_verify_terms(spark):
    standard = spark.createDataFrame([(0, "측정일자", "", "측정날짜,채수일"), (1, "시설명", "", "채수일"), (2, "측정", "", "")],
                                     "row_no int, term_name string, description string, synonyms string")
    targets = spark.createDataFrame([("a", "측정일자"), ("b", "채수일"), ("c", "측정시설명"), ("d", "모름")], "code string, std_name string")
    words = terms.word_list(spark.createDataFrame(
        [(0, "측정", "MSRM", ""), (1, "시설", "FCLT", ""), (2, "명", "NM", ""), (3, "모름", "X", "폐기")],
        "row_no int, word string, abbr string, revision string"))
    got = {r.code: r for r in terms.verify_terms(targets, standard, words, related=6).collect()}
    assert [got[c].verdict for c in "abcd"] == ["listed", "synonym", "composed", "missing"]
    assert got["b"].official == "측정일자" and got["c"].parts == ["측정", "시설", "명"]
    assert got["c"].related == ["시설명", "측정"] and got["a"].related == ["측정"]
    abbr = terms.composed_abbreviations(terms.segment_terms(targets.select(F.col("std_name").alias("term")), words), words)
    assert {r.term: r.abbr for r in abbr.collect()}["측정시설명"] == "MSRM_FCLT_NM"
    assert terms.verify_terms(targets, standard, related=6).where("code = 'd'").first().verdict == "unchecked"
    top = terms.similar_names(targets.select(F.col("std_name").alias("term")), standard.select(
        "row_no", "term_name"), 2).where("term = '측정시설명'").orderBy("place").collect()
    assert [r.official for r in top] == ["시설명", "측정"]


def test_standard_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "terms.csv"
    path.write_bytes("번호,영문용어명,공통표준용어명,용어설명,이음동의어목록\n1,x,측정일자,설명글,\"가,나\"\n".encode("cp949"))
    row = dictionaries.read_standard_terms(spark, str(path)).first()
    assert (row.term_name, row.description, row.synonyms) == ("측정일자", "설명글", "가,나")
    with pytest.raises(dictionaries.HeaderNotFound):
        dictionaries.pick_column(["영문용어명"], "용어명")


def test_upsert_is_idempotent(spark):
    current = spark.createDataFrame([(1, None, "old", 5)], "a int, b string, v string, made int")
    changes = spark.createDataFrame([(1, None, "new", 9, 1), (1, None, "newer", 9, 2), (2, "x", "in", 7, 1)],
                                    "a int, b string, v string, made int, at int")
    once = tables.upsert(current, changes, ["a", "b"], ["v"], "at")
    assert sorted(map(tuple, once.collect())) == [(1, None, "newer", 5), (2, "x", "in", 7)]
    twice = tables.upsert(once, changes, ["a", "b"], ["v"], "at")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_promotion(spark):
    queue = spark.createDataFrame([(1, "x", None, date(2024, 1, 1), "pending", None), (2, "y", "s", date(2024, 1, 2), "pending", None)],
                                  "id int, surface string, source_id string, first_seen_on date, status string, resolved_by string")
    decisions = spark.createDataFrame([(1, "WQ-001", "박"), (9, "WQ-001", "박")], "id int, code string, reviewer string")
    synonyms, after = tables.promote_sightings(queue, decisions)
    row = synonyms.first()
    assert (row.measurement_code, row.metadata_code, row.source_id, row.collected_on) == ("WQ-001", None, "MANUAL", date(2024, 1, 1))
    assert {(r.id, r.status) for r in after.collect()} == {(1, "promoted"), (2, "pending")}
    assert [r.id for r in tables.unknown_decisions(queue, decisions).collect()] == [9]


def test_hand_over_once(spark, tmp_path):
    items = spark.createDataFrame(
        [(1, "f", "a", "WQ-001", 70.0, "WQ-001", "박", 5, None), (2, "f", "b", None, None, "기각", "박", 5, None),
         (3, "f", "c", None, None, "no_match", "박", 5, None), (4, "f", "d", None, None, None, None, None, None)],
        "id int, file_id string, raw string, candidate_code string, score double, verdict string, reviewed_by string, "
        "reviewed_at int, exported_at timestamp")
    files = spark.createDataFrame([("f", "f.csv")], "file_id string, original_filename string")
    dry, same = plans.hand_over(items, files, str(tmp_path / "q"), datetime(2026, 8, 8), dry_run=True)
    assert dry.count() == 1 and same is items
    lines, after = plans.hand_over(items, files, str(tmp_path / "q"), datetime(2026, 8, 8))
    assert [tuple(r) for r in lines.collect()] == [("a", "f.csv", "WQ-001", "70.0", "WQ-001", "박")]
    assert plans.hand_over(after, files, str(tmp_path / "q2"), datetime(2026, 8, 9), dry_run=True)[0].count() == 0


def test_listing_refuses_unknown_status(spark):
    with pytest.raises(review.ReviewRequestError):
        review.listing(spark.range(1), "open")


def test_open_sightings_most_seen_first(spark):
    queue = spark.createDataFrame([("a", None, 1, "pending"), ("b", None, 5, "pending"), ("c", None, 9, "promoted")],
                                  "surface_norm string, source_id string, seen_count int, status string")
    assert [r.surface_norm for r in tables.open_sightings(queue).collect()] == ["b", "a"]


def test_targets_are_unverified_terms(spark):
    df = spark.createDataFrame([("a", "미확인 — 소스"), ("b", "공통표준용어"), ("c", None)], "code string, standard_basis string")
    assert [r.code for r in terms.verification_targets(df).collect()] == ["a"]
