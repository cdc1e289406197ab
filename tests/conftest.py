import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from hydromelt import session  # noqa: E402

MEASUREMENT_HEADER = "code,name_ko,name_en,abbr,synonyms,unit,category,legal_basis,verified,note"
METADATA_HEADER = "code,name_ko,name_en,abbr,synonyms,unit,category,reference,verified,note"
MEASUREMENT = [
    "WQ-101,탁도,Turbidity,TURB,흐림정도|turbVal,NTU,일반,,Y,",
    "WQ-102,전기전도도,Electric Conductivity,EC,도전율|elecCond,µS/cm,일반,,Y,",
    "WQ-104,용존산소,Dissolved Oxygen,DO,녹은산소|oxyDis,mg/L,일반,,Y,",
    "WQ-105,암모니아성질소,Ammonia Nitrogen,NH3-N,암모니아질소,mg/L,영양염류,,Y,",
    "WQ-106,염분,Salinity,SAL,소금기|saltVal,psu,일반,,N,",
]
METADATA = [
    "MD-301,하천명,River Name,RVNM,강이름,,station,,Y,",
    "MD-302,조사번호,Survey Number,SVNO,조사순번,,record,,Y,",
    "MD-303,조사일자,Survey Day,SVDT,조사한날,,time,,Y,",
    "MD-304,조사기관,Surveyor,SVORG,,,organization,,Y,",
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = str(tmp_path_factory.mktemp("scratch"))
    built = session.build("tests", "local[4]", **{
        "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false",
        "spark__checkpoint__dir": scratch, "spark__driver__memory": "6g",
        "spark__driver__host": "localhost", "spark__driver__bindAddress": "127.0.0.1"})
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


@pytest.fixture(scope="session")
def dictionary_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dictionary")
    (folder / "measurement_terms.csv").write_text(
        "\n".join([MEASUREMENT_HEADER, *MEASUREMENT]) + "\n", encoding="utf-8-sig")
    (folder / "metadata_terms.csv").write_text(
        "\n".join([METADATA_HEADER, *METADATA]) + "\n", encoding="utf-8-sig")
    return str(folder)


@pytest.fixture(scope="session")
def lexicon(spark, dictionary_dir):
    from hydromelt.plans import mapping
    return session.stage(mapping.load_lexicon(spark, dictionary_dir), "lexicon")


@pytest.fixture(scope="session")
def samples(tmp_path_factory):
    from tests_support import write_xlsx
    folder = tmp_path_factory.mktemp("samples")
    write_xlsx(folder / "plain.xlsx", [
        ["하천명", "조사일자", "탁도", "turbVal", "소금기"],
        ["솔내", "2021-05-04", 3.5, 3.25, 0.5], ["갈내", "2021-05-05", 4.5, 4.75, 0.75]])
    write_xlsx(folder / "odd_names.xlsx", [
        ["하천명", "전기전도도값", "물속의 산소(DO_mg/L)", "PUMP_HR", "OPR_NM"],
        ["솔내", 310, 8.5, 11, "가조"], ["갈내", 295, 9.25, 12, "나조"]])
    write_xlsx(folder / "titled.xlsx", [
        ["봄철 조사 묶음", None, None, None],
        ["조사번호", "NH3-N", "녹은산소", "탁도(NTU)"],
        ["K-7", 0.25, 8.25, 3.75], ["K-8", 0.5, 8.75, 4.25]])
    (folder / "~$lock.xlsx").write_bytes(b"x")
    (folder / "notes.txt").write_text("x")
    return str(folder)


