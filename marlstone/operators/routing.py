"""Which reader takes a file, and what a failure means; column expressions over file facts and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: suffixes, codes and the messages that tell them ---------------
IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
MEDIA = ("mp3", "wav", "m4a", "flac", "ogg", "oga", "aac", "wma", "mp4", "mkv", "mov", "avi", "webm", "m4v", "wmv", "mpg", "mpeg")
FALLBACKS = {"mineru": "MS-114", "pdflayout": "MS-120", "pdf_analysis": "MS-121", "ocr_pdf": "MS-121", "ocr_image": "MS-122", "whisper": "MS-123", "pdftext": "MS-124"}
LADDER = (
    (r"password|encrypt|decrypt", "MS-101"),
    (r"WinError 32|being used by another process|Errno 13|Permission denied|PermissionError", "MS-102"),
    (r"File does not exist|FileNotFoundError|No such file|cannot find the (?:file|path)", "MS-103"),
    (r"Path is a directory", "MS-104"),
    (r"UnsupportedFormatException|Unsupported format|no converter", "MS-105"),
    (r"EmptyOutputError|produced no text", "MS-106"),
    (r"BadZipFile|not a zip file|corrupt|damaged|truncated|EOFError|Unexpected EOF|PSEOF|PSSyntaxError|PDFSyntaxError|No /Root object|invalid.{0,20}header", "MS-107"),
    (r"MemoryError", "MS-108"),
    (r"codec|moov atom|InvalidDataError|DecoderNotFound", "MS-109"),
)
NETWORK = r"(?i)ConnectionError|URLError|getaddrinfo|Name or service|NameResolution|HTTPSConnectionPool|LocalEntryNotFound|offline|timed out|Max retries|SSLError"
QUOTED = "'[^']*'|\"[^\"]*\""
EMPTY_BYTES = 16_384
SCAN_TEXT, SCAN_IMAGE, SCAN_PATHS, SCAN_SHARE = 24, 0.45, 12, 0.15
LAYOUT_CHARS = 50
URL_BYTES = 50 * 1024 * 1024
#: Code, severity and a title and next step in our own words.
CATALOG = (
    ("MS-101", "error", "The document is protected by a password or encrypted.", "Remove the protection and run the file again."),
    ("MS-102", "error", "Another program holds the file.", "Close it there and run the file again."),
    ("MS-103", "error", "The file isn't where it was.", "Add it from where it is now."),
    ("MS-104", "error", "A folder was given instead of a file.", "Add the files in it."),
    ("MS-105", "error", "No reader knows this type of file.", "Export it in a supported format."),
    ("MS-106", "error", "Reading the file gave no text.", "Look whether it is damaged or only an image."),
    ("MS-107", "error", "The file is damaged or not whole.", "Get or export it anew."),
    ("MS-108", "error", "The file needs more memory than there is.", "Split it."),
    ("MS-109", "error", "The sound or video can't be decoded.", "Export it in a common format."),
    ("MS-110", "error", "The file has no text layer and text recognition is off.", "Turn text recognition on."),
    ("MS-111", "error", "The speech model couldn't be fetched.", "Check the connection."),
    ("MS-112", "error", "Transcription failed.", "Try another format."),
    ("MS-113", "error", "Text recognition failed.", "Check its installation."),
    ("MS-114", "warning", "The layout server gave no result; a local reader took over.", "Check the server."),
    ("MS-115", "error", "Transcription is off.", "Turn it on."),
    ("MS-120", "warning", "The layout reader failed; the plain one took over.", "Compare the result."),
    ("MS-121", "warning", "Scanned pages weren't recognised.", "Check text recognition."),
    ("MS-122", "warning", "The image wasn't recognised.", "Check text recognition."),
    ("MS-123", "warning", "The recording wasn't transcribed.", "Check transcription."),
    ("MS-124", "warning", "The result has no page anchors.", "None needed."),
    ("MS-125", "warning", "The file can't be opened as PDF.", "Get it anew."),
    ("MS-130", "error", "The address couldn't be downloaded.", "Check it."),
    ("MS-131", "error", "The link isn't a web address of an allowed size.", "Use http or https."),
    ("MS-132", "error", "There is no such section.", "Ask for the outline."),
    ("MS-199", "error", "Reading failed for an unknown reason.", "Look at the log."),
    ("MS-201", "error", "The folder can't be written to.", "Choose another."),
    ("MS-202", "error", "The disk is full.", "Make room."),
    ("MS-203", "error", "The path is too long.", "Choose a shorter one."),
    ("MS-204", "error", "A file to be written is open elsewhere.", "Close it."),
    ("MS-299", "error", "Saving failed.", "Look at the log."),
    ("MS-301", "warning", "The model server didn't answer.", "Start it."),
    ("MS-302", "warning", "The model server lacks the model.", "Install it."),
    ("MS-303", "warning", "The model server took too long.", "Choose a smaller model."),
    ("MS-304", "warning", "The summary was refused by the checks.", "None needed."),
    ("MS-399", "warning", "The model server failed.", "Look at its log."),
    ("MS-900", "error", "The program stopped on a fault of its own.", "Look at the log."),
    ("MS-901", "error", "Something unforeseen happened.", "Look at the log."),
)


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOG), "code string, severity string, title string, next_step string")


def classify(error: Column) -> Column:
    """The code of a reading error: the first rung whose words are there, outside quotes."""
    bare = F.regexp_replace(error, QUOTED, "")
    out = F.lit("MS-199")
    for pattern, code in reversed(LADDER):
        out = F.when(F.regexp_like(bare, F.lit(f"(?i){pattern}")), code).otherwise(out)
    return F.when(error.isNull(), None).otherwise(out)


def is_network(error: Column) -> Column:
    return F.regexp_like(error, F.lit(NETWORK))


def classify_os(errno: Column, winerror: Column, permission: Column) -> Column:
    return (
        F.when(winerror.isin(32, 33), "MS-204").when(winerror.isin(39, 112) | (errno == 28), "MS-202")
        .when((winerror == 206) | (errno == 36), "MS-203").when(permission | errno.isin(13, 1, 30), "MS-201").otherwise("MS-299")
    )


def classify_http(status: Column, reason: Column, connection: Column) -> Column:
    """``status`` is null where the request had no answer; ``connection`` says that it failed on the way."""
    late = F.contains(reason, F.lit("timed out"))
    return F.when(status == 404, "MS-302").when(status.isNotNull(), "MS-399").when(F.coalesce(late, F.lit(False)), "MS-303").when(connection, "MS-301").otherwise("MS-399")


def route_failure(route: Column, error: Column) -> Column:
    """Why transcription or image recognition failed."""
    own = classify(error)
    picture = F.regexp_like(error, F.lit(r"^\w*Image\w*:|cannot identify image"))
    return F.when(own.isin("MS-102", "MS-107", "MS-108", "MS-109"), own).when(route == "whisper", F.when(is_network(error), "MS-111").otherwise("MS-112")).when(picture, "MS-107").otherwise("MS-113")


def has_text(text: Column) -> Column:
    """A word that isn't the literal None."""
    return F.exists(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: w != "None")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def route(files: DataFrame) -> DataFrame:
    """Adds ``route`` to files(path, exists, is_dir, ocr, pdf_ocr, mineru, layout, audio, anchors, scanned_ratio, body_chars): the first reader of the cascade that would take it."""
    ext = suffix(F.col("path"))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    pdf, enough = ext == "pdf", F.coalesce(F.col("body_chars"), F.lit(0)) >= LAYOUT_CHARS
    scanned = F.coalesce(F.col("scanned_ratio"), F.lit(0.0)) >= SCAN_SHARE
    return files.withColumn("route", (
        F.when(~on("exists"), "missing").when(on("is_dir"), "directory").when(ext.isin(*IMAGES) & on("ocr"), "ocr").when(pdf & on("mineru"), "mineru")
        .when(pdf & on("pdf_ocr") & scanned, "ocr+text").when(pdf & on("layout") & enough, "pdflayout").when(pdf & on("anchors") & enough, "pdftext")
        .when(ext.isin(*MEDIA) & on("audio"), "whisper").otherwise("markitdown")
    ))


def empty_guard(text: Column, size: Column, path: Column, ocr: Column) -> Column:
    """The error of a result without text, null where it stands."""
    ext = suffix(path)
    big = F.concat(F.lit("EmptyOutputError: the converter produced no text from this "), F.format_number(size, 0), F.lit("-byte file"))
    off = ~F.coalesce(ocr, F.lit(False)) & ((ext == "pdf") | ext.isin(*IMAGES))
    return F.when(~has_text(text), F.when(size >= EMPTY_BYTES, big).when(off, "EmptyOutputError: no text layer, and OCR is turned off"))


def diagnose(results: DataFrame) -> DataFrame:
    """Adds error_code and warnings to results(path, error, ocr, audio, failures array<struct<route, error>>)."""
    ext, code = suffix(F.col("path")), classify(F.col("error"))
    named = lambda r: F.element_at(F.filter("failures", lambda f: f["route"] == r), 1)["error"]
    seen = lambda r: F.exists("failures", lambda f: f["route"] == r)
    special = F.when(seen("whisper"), route_failure(F.lit("whisper"), F.try_element_at(F.filter("failures", lambda f: f["route"] == "whisper"), F.lit(1))["error"]))
    special = special.when(seen("ocr_image"), route_failure(F.lit("ocr_image"), F.try_element_at(F.filter("failures", lambda f: f["route"] == "ocr_image"), F.lit(1))["error"]))
    no_audio = ext.isin(*MEDIA) & ~F.coalesce("audio", F.lit(False))
    no_ocr = (code == "MS-106") & ~F.coalesce("ocr", F.lit(False)) & ((ext == "pdf") | ext.isin(*IMAGES))
    final = F.when(special.isNotNull() & ~code.isin("MS-101", "MS-102"), special).when(code.isin("MS-105", "MS-106", "MS-199"), F.when(no_audio, "MS-115").when(no_ocr, "MS-110").otherwise(code)).otherwise(code)
    unreadable = lambda f: F.startswith(f["error"], F.lit("PdfiumError")) & F.contains(f["error"], F.lit("load document"))
    table = F.create_map(*[F.lit(x) for kv in FALLBACKS.items() for x in kv])
    warned = F.array_distinct(F.array_compact(F.transform("failures", lambda f: F.when(unreadable(f), "MS-125").otherwise(F.try_element_at(table, f["route"])))))
    ok = F.col("error").isNull()
    return results.withColumns({"error_code": F.when(~ok, final), "warnings": F.when(ok, warned).otherwise(F.array().cast("array<string>"))})


def triage(pages: DataFrame) -> DataFrame:
    """Per document of pages(doc_id, page, text_len, image_area, page_area, path_count): scanned pages, their share, and whether they need recognition."""
    visual = (F.col("image_area") / F.nullif(F.col("page_area"), F.lit(0.0)) >= SCAN_IMAGE) | (F.col("path_count") >= SCAN_PATHS)
    scanned = (F.col("text_len") < SCAN_TEXT) & F.coalesce(visual, F.lit(False))
    out = pages.withColumn("scanned", scanned).groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.count_if("scanned").alias("n_scanned"), F.array_sort(F.collect_list(F.when(F.col("scanned"), F.col("page")))).alias("scanned_pages"))
    return out.withColumn("scanned_ratio", F.col("n_scanned") / F.col("total_pages")).withColumn("needs_ocr", F.col("scanned_ratio") >= SCAN_SHARE)


def url_guard(url: Column, size: Column) -> Column:
    """MS-131 for what may not be downloaded, else null."""
    web = F.regexp_like(url, F.lit(r"(?i)^https?://[^/\s]+"))
    return F.when(~F.coalesce(web, F.lit(False)) | (size > URL_BYTES), "MS-131")


def url_suffix(url: Column) -> Column:
    """Suffix of a download's file: the path's, else .html."""
    found = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[^:]+://[^/]+/(?:.*/)?[^/]*?(\.[A-Za-z0-9]+)$", 1)
    return F.when(found == "", ".html").otherwise(F.lower(found))
