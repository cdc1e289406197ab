"""Settings and fixed values.

Everything under "fixed values" is data: codes, word lists, patterns and texts
that stored files and reports use verbatim, so they are spelled out here once.
"""

from __future__ import annotations

# --- fixed values: matching thresholds (0-100 similarity) -------------------
FUZZY_AUTO_THRESHOLD = 85
FUZZY_REVIEW_THRESHOLD = 70
COMPOSITE_MIN_TAIL_LEN = 2
TRIGRAM_MIN_SCORE = 0.45
MATCH_LIMIT = 5

# --- fixed values: file reading --------------------------------------------
HEADER_SCAN_ROWS = 5
MERGED_HEADER_MIN_LABELS = 2
CSV_ENCODINGS = ("utf-8-sig", "cp949", "euc-kr")
DATA_SUFFIXES = (".csv", ".xlsx", ".xlsm", ".xls")
EXCEL_SUFFIXES = (".xlsx", ".xlsm", ".xls")
SKIPPED_NAME_PREFIXES = ("~$", ".")
MISSING_CELL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- fixed values: output naming -------------------------------------------
UNMAPPED_PREFIX = "UNMAPPED_"
UNNAMED_PREFIX = "UNNAMED_"
SITE_SEPARATOR = "@"

# --- fixed values: dictionary kinds and statuses ---------------------------
DICT_MEASUREMENT = "측정항목"
DICT_METADATA = "메타"
MEASUREMENT_PREFIX = "WQ-"
METADATA_PREFIX = "MD-"
STATUSES = ("exact", "fuzzy_auto", "needs_review", "unmapped")
AUTO_STATUSES = ("exact", "fuzzy_auto")
HUMAN_STATUSES = ("needs_review", "unmapped")

# --- fixed values: column roles (standard codes in priority order) ----------
ROLE_CODES = {
    "site": ("MD-034", "MD-001", "MD-003", "MD-004"),
    "outlet": ("MD-033",),
    "date": ("MD-011", "MD-006", "MD-041", "MD-029"),
    "datetime": ("MD-007",),
    "year": ("MD-008",),
    "month": ("MD-009",),
    "period": ("MD-010",),
}
LIMIT_CODES = ("MD-054", "MD-055")
SAMPLE_TYPE_RAW_NAMES = ("시료구분", "시료종류", "채수구분")
SAMPLE_TYPE_VALUES = ("원폐수", "방류수", "유입수", "처리수", "방류", "원수")
INFLUENT = "원폐수"

# --- fixed values: cell texts ----------------------------------------------
NON_NUMERIC_MARKERS = ("불검출", "검출안됨", "n.d.", "nd", "-", "–", "없음", "미검출", "해당없음")
PREVIEW_ROW_LIMIT = 10

# --- fixed values: review verdicts -----------------------------------------
VERDICT_ACCEPT = "승인"
VERDICT_REJECT = "기각"
VERDICT_NO_MATCH = "no_match"
QUEUE_ACCEPT_WORDS = ("승인", "accept", "y", "yes", "ok")
QUEUE_REJECT_WORDS = ("기각", "reject", "x", "no", "제외", "skip")
DECISION_ACCEPT_WORDS = ("승인", "approved")
DECISION_REJECT_WORDS = ("no_match", "기각", "rejected", "none", "unmapped")
UNKNOWN_REVIEWER = "미상"
UNSTATED_REVIEWER = "미기재"
QUEUE_COLUMNS = ("원본명", "출처파일", "후보 표준코드", "점수", "사람판정", "판정자")
REVIEW_LOG_COLUMNS = ("dict_file", "code", "synonym", "source", "collected_at", "reviewer")
DICT_FILES = {"measurement": "measurement_terms.csv", "metadata": "metadata_terms.csv"}
REVIEW_SOURCE_ID = "HUMAN_REVIEW"
REVIEW_SOURCE = {
    "source_id": REVIEW_SOURCE_ID,
    "source_name": "매핑 파이프라인 리뷰 대기열 승인분",
    "organization": "팀 자체 검수",
    "source_type": "manual",
    "base_url": "",
    "access_note": "",
    "encoding": "UTF-8",
    "reliability": "observed",
}

EVIDENCE_PREFIX = "출처파일: "
IMPORT_NOTE = ("리뷰 대기열 승인 (판정자: ", ")")

# --- fixed values: report keys and official table headers --------------------
REPORT_KEYS = {"filename": "파일", "header_row": "헤더 행"}
REPORT_COLUMN_KEYS = {
    "raw": "원본명", "normalized": "정규화명", "status": "결과", "via": "판정경로", "any_code": "표준코드",
    "site": "지점명", "output_column": "출력 컬럼명", "matched_variant": "매칭 문자열", "score": "점수",
    "dict_type": "사전 종류"}
REPORT_SUMMARY_KEYS = {
    "total_columns": "전체 컬럼 수", "auto_mapped": "자동 매핑 수", "needs_review": "확인 필요 수", "unmapped": "실패 수",
    "auto_mapped_rate": "자동 매핑률", "needs_review_rate": "확인 필요율", "unmapped_rate": "실패율"}
TERM_HEADERS = {"term_name": "용어명", "description": "설명", "synonyms": "이음동의어"}
WORD_HEADERS = {"word": "단어명", "abbr": "단어영문약어명", "revision": "개정구분"}
WORD_DESCRIPTION_HEADERS = ("단어 설명", "단어설명")
ENGLISH_HEADER_MARK = "영문"
TOXIC_BASIS = ("제", "호(", ")")
NOT_TOXIC_BASIS = "별표 3 목록에 없음"

# --- fixed values: standards and analyses -----------------------------------
DEFAULT_STANDARD_SET = "배출허용기준"
SCALES = ("large", "small")
OVER_LIMIT = "상한 초과"
UNDER_LIMIT = "하한 미달"
RULESET_VERSION = "rules-2026-08-11"
ASSUMPTIONS = {
    "bucket": "집계 단위를 월별로 두었습니다",
    "metric": "지표를 평균으로 두었습니다",
    "period": "기간을 전체로 두었습니다",
    "region_grade": "지역구분을 지정하지 않아 기준선을 표시하지 않습니다",
    "scale": "폐수배출규모를 지정하지 않아 규모별 기준선은 표시하지 않습니다",
}

# --- fixed values: controlled vocabularies of the dictionary tables ----------
LEGAL_STATUSES = ("statutory", "superseded", "non_statutory")
REVIEW_STATUSES = ("draft", "verified", "rejected")
VALUE_TYPES = ("text", "code", "integer", "numeric", "date", "timestamp", "geo", "boolean")
FACETS = ("station", "time", "space", "organization", "sampling", "quality", "record")
SOURCE_TYPES = ("api", "file", "spec", "legal", "manual")
RELIABILITIES = ("legal", "standard", "observed", "spec", "inferred")
SYNONYM_TYPES = ("column_name", "legal_variant", "abbreviation", "colloquial", "typo",
                 "deprecated_std_name")
UNRESOLVED_STATUSES = ("pending", "promoted", "rejected", "ignored")
EXPECTED_TOXIC_TERMS = 32
EXPECTED_STATUTORY_TERMS = 57
UNVERIFIED_BASIS = "미확인"
DROPPED_WORD_REVISION = "폐기"

# --- fixed values: name patterns --------------------------------------------
SEPARATORS = r"[\s_\-·.,;:/\\]+"
BRACKET_GROUP = r"\(([^()]*)\)"
BRACKET_TOKEN_SEPARATORS = r"[\s_/,;·+&]+"
TOKEN_NOISE = r"[\s\-_.]+"
NUMBER_TOKEN = r"^\d+(?:\.\d+)?$"
UNIT_TOKEN = (
    r"^(?:"
    r"(?:mg|㎎|ug|µg|μg|ng|g)(?:/|당)?l?"
    r"|l당mg|mg당l|mgl|l"
    r"|°c|℃"
    r"|tu|ntu|jtu"
    r"|cfu(?:/?\d*ml)?|mpn(?:/?\d*ml)?"
    r"|%|퍼센트|psu"
    r"|(?:µ|u|μ)s/?cm"
    r"|\d+(?:\.\d+)?(?:ml|㎖)?"
    r"|개(?:/?ml)?"
    r")$"
)
TRAILING_UNIT = (
    r"(?:"
    r"(?:mg|㎎|ug|µg|μg|ng)당?l?"
    r"|l당mg|mg당l"
    r"|°c"
    r"|ntu|jtu|tu"
    r"|cfu(?:\d*ml)?|mpn(?:\d*ml)?"
    r"|%|퍼센트|psu"
    r"|(?:µ|u|μ)scm"
    r")$"
)
NUMERIC_CELL = r"^[<>≤≥]?\s*(-?\d+(?:\.\d+)?)\s*$"
KEY_NOISE = "[^0-9A-Za-z가-힣]"
ALIAS_NOISE = r"[\s_\-./()\[\]{}]+"

# --- tuning -----------------------------------------------------------------
# Files above this size are read line by line, split over many tasks.
WHOLE_FILE_BYTES = 256 * 1024 * 1024
# Most rows per file of an intermediate table.
STAGE_FILE_ROWS = 250_000
# Most bytes of a batch of rows on its way to Python: JVM and worker each hold some at once, and long texts fill a batch of 10,000 rows with far more.
ARROW_BATCH_BYTES = 4 << 20
# Most bytes of files that one task gets of a table that is dealt out; rows take a multiple of that in memory.
SPREAD_BYTES = 8 << 20
# Splits of compute-heavy stages per shuffle partition.
SPLITS_PER_SHUFFLE_PARTITION = 2
# Most rows a join side may have to be broadcast; layout rows run to some kilobytes.
BROADCAST_ROWS = 5_000
# The same for two numbers per file.
BROADCAST_FILES = 1_000_000
# The same for one small row per file block.
BROADCAST_BLOCKS = 1_000_000
# Widest run of positions that one numbering task handles.
NUMBERING_CHUNK = 4096
