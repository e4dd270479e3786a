"""Words, names and numbers that results depend on."""

# Words that stand for "no value" in a code sheet. The empty string is not one of them.
NA_WORDS = ("#N/A", "#NA", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Header cell that starts the column rows of a schema descriptor and of a schema web table.
HEADER_MARKER = "컬럼한글명"

# Labels on a schema page, also the preamble lines of a schema descriptor.
SERVICE_LABEL = "서비스명"
PROVIDER_LABEL = "제공기관/제공부서"
TABLE_LABEL = "상세설명 표"

# Category code -> category name.
CATEGORIES = {"01": "건축인허가", "02": "주택인허가", "03": "건축물대장"}

# Archive names: {publisher}_{category}_{dataset}+({year}년+{month}월).zip
PUBLISHER = "국토교통부"

# Code-sheet columns, in sheet order.
SHEET_COLUMNS = (
    "시도",
    "시군구",
    "행정구역명",
    "행정동 (행정기관명)",
    "법정동",
    "행정구역분류",
    "행정기관코드",
    "행정기관 생성일",
    "법정동코드",
    "법정동 관할구역 분할여부",
    "행정동 영문명칭",
    "비고",
)

# District classes and how many districts each should hold.
SPECIAL_CITY = "세종특별자치시"
ADMIN_CITY_PROVINCE = "제주특별자치도"
EXPECTED_DISTRICTS = {"Autonomous": 226, "Non-autonomous": 41, "Special": 1}
KNOWN_DISTRICTS = ("강남구", "수원시", "세종특별자치시")

# Patterns of names and types. A number type: precision, and scale where there is one.
NUMERIC_TYPE = r"NUMERIC\((\d+)(?:,(\d+))?\)"
# The date of an edition in a file name: year, month, day.
EDITION_DATE = r"(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})\.기준"
# Date suffixes of dataset names, in the order in which they are dropped.
DATE_SUFFIXES = (r"\s*\(\d{4}년\s*\d{1,2}월\)$", r"\s*\(\d{4}\.\d{1,2}\)$", r"\s*\(\d{4}\)$")
# An archive's name: publisher, category, dataset, year and month.
ARCHIVE_NAME = r"\A{publisher}_(.*?)_(.*?)\+\({year}년\+{month}월\)\.zip"

# Web-page calls that carry download and description arguments.
DOWNLOAD_CALL = "fnDownloadPop"
DESCRIBE_CALL = "fnLgcptPop"

# Candidate encodings of an encoding audit.
ENCODINGS = ("utf-8", "cp949", "euc-kr", "iso-8859-1")

# The JVM's names of code pages.
CODE_PAGES = {"cp949": "x-windows-949", "uhc": "x-windows-949", "ms949": "x-windows-949", "euc-kr": "EUC-KR", "euc_kr": "EUC-KR"}

MAX_DECIMAL_PRECISION = 38
