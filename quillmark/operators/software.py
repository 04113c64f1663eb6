"""Creator and producer software, AI markers in metadata, and the findings they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import dates
from quillmark.functions import text as t

# Product names by category, in order of precedence. A name counts if it occurs as whole words.
SOFTWARE = {
    "generative_tool": (
        "adobe firefly", "automatic1111", "chatgpt", "comfyui", "dall e", "deepai", "dreamstudio", "firefly", "flux ai", "fooocus", "google imagen",
        "ideogram", "invokeai", "leonardo ai", "midjourney", "nightcafe", "openai image", "playground ai", "stable diffusion", "stability ai",
    ),
    "visual_editor": (
        "adobe photoshop", "affinity photo", "capture one", "corel paintshop", "darktable", "digikam", "gimp", "krita", "lightroom", "luminar",
        "paint net", "photofiltre", "photopea", "photoscape", "pixelmator", "rawtherapee",
    ),
    "design_tool": (
        "adobe illustrator", "adobe indesign", "affinity designer", "affinity publisher", "canva", "coreldraw", "figma", "inkscape",
        "microsoft publisher", "quarkxpress", "scribus", "sketch app", "vista create", "vistacreate",
    ),
    "pdf_editor": (
        "abbyy finereader pdf", "bluebeam revu", "corel pdf fusion", "drawboard pdf", "foxit phantompdf", "foxit pdf editor", "kofax power pdf",
        "libreoffice draw", "master pdf editor", "nitro pdf pro", "nitro pro", "nuance power pdf", "pdf architect", "pdf expert", "pdfill pdf tools",
        "pdfsam", "pdf xchange editor", "pdfelement", "qoppa pdf studio", "updf", "wondershare pdfelement",
    ),
    "online_pdf_service": (
        "avepdf", "cleverpdf", "cloudconvert", "compress2go", "convertio", "deftpdf", "dochub", "docupub", "freepdfconvert", "hipdf", "i love pdf",
        "ilovepdf", "lightpdf", "neevia document converter", "neevia pdfmerge", "neevia technology", "online2pdf", "online convert", "pdf io",
        "pdf24", "pdfaid", "pdf candy", "pdf filler", "pdf2go", "pdfescape", "pdffiller", "pdfresizer", "pdfsimpli", "pdfpro", "sejda", "smallpdf",
        "soda pdf", "tinywow", "xodo", "zamzar",
    ),
    "scanner": (
        "adobe scan", "brother", "camscanner", "canon", "controlcenter", "document capture pro", "doxie", "epson scan", "fi series", "fujitsu",
        "genius scan", "hp scan", "image capture", "iriscanner", "konica minolta", "kyocera", "microsoft lens", "naps2", "notes scanner",
        "office lens", "pfi scan", "ricoh", "scansnap", "xerox",
    ),
    "signature_service": (
        "adobe sign", "certigna", "docusign", "dropbox sign", "eversign", "hellosign", "signaturit", "signnow", "universign", "yousign",
    ),
    "document_generator": (
        "adobe acrobat", "adobe pdf library", "acrobat distiller", "antenna house", "apache fop", "apache pdfbox", "aspose pdf", "apple keynote",
        "apple numbers", "apple pages", "borb", "cairo", "chromium", "crystal reports", "cups", "devexpress", "dompdf", "fpdf", "ghostscript",
        "google docs", "google sheets", "google slides", "ironpdf", "itext", "jasperreports", "latex", "libreoffice", "microsoft excel",
        "microsoft powerpoint", "microsoft print to pdf", "microsoft report", "microsoft word", "microsoft xps", "macos preview", "mpdf", "mupdf",
        "openoffice", "oracle bi publisher", "pagespeed", "pdfcreator", "pdfkit", "pdfium", "pdfmake", "pdftex", "princexml", "prawn", "pypdf",
        "pypdf2", "qpdf", "questpdf", "quartz pdfcontext", "reportlab", "sap crystal", "skia pdf", "spire pdf", "syncfusion", "tcpdf", "telerik",
        "wkhtmltopdf", "weasyprint", "xetex",
    ),
}
# Default points of the categories that carry risk.
POINTS = {"online_pdf_service": 5.0, "pdf_editor": 3.0, "design_tool": 5.0, "visual_editor": 8.0, "generative_tool": 8.0}
# Texts that name a generating tool, and the markers that they give.
AI_MARKERS = {
    "automatic1111": "automatic1111", "comfyui": "comfyui", "dall-e": "dall-e", "firefly": "adobe_firefly", "fooocus": "fooocus",
    "gpt image": "gpt_image", "invokeai": "invokeai", "midjourney": "midjourney", "novelai": "novelai",
    "stable diffusion": "stable_diffusion", "stability ai": "stability_ai",
}
# Points and confidence of a declared algorithmic origin, by the trust in its signature.
DECLARATIONS = {"trusted": (45.0, 0.99), "valid": (45.0, 0.85), "untrusted": (40.0, 0.65), "unknown": (30.0, 0.55), "not_applicable": (0.0, 0.0), "invalidated": (0.0, 0.0)}


def software_category(value: Column) -> Column:
    """The first category with a name in the value, ``unknown`` if none: one alternation per category, in the plan itself."""
    s = F.concat(F.lit(" "), t.folded(value), F.lit(" "))
    out = None
    for category, names in SOFTWARE.items():
        hit = s.rlike(" (?:" + "|".join(names) + ") ")
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return F.when(value.isNotNull(), out.otherwise("unknown"))


def software_points(category: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, category), F.lit(0.0))


def software_finding(metadata: DataFrame) -> DataFrame:
    """(doc_id, key, category, points): the strongest of a document's creator and producer; the creator on ties.

    metadata: doc_id, key, value.
    """
    category = software_category(F.col("value"))
    rows = metadata.where(F.col("key").isin("Creator", "Producer")).select("doc_id", "key", category.alias("category"))
    rows = rows.withColumn("points", software_points(F.col("category"))).where("points > 0")
    w = Window.partitionBy("doc_id").orderBy(F.desc("points"), "key")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def ai_markers(metadata: DataFrame) -> DataFrame:
    """Distinct (doc_id, marker, key) of metadata entries (doc_id, key, value) that name a generating tool."""
    text = F.lower(F.concat_ws(" ", "key", F.coalesce("value", F.lit(""))))
    named = F.array(*[F.when(text.contains(needle), F.lit(marker)) for needle, marker in AI_MARKERS.items()])
    diffusion = F.lower("key").contains("parameters") & (text.contains("negative prompt") | (text.contains("sampler") & text.contains("steps")))
    every = F.array_compact(F.concat(named, F.array(F.when(diffusion, "diffusion_generation_parameters"))))
    return metadata.select("doc_id", F.explode(every).alias("marker"), "key").distinct()


def provenance_points(state: Column, trust: Column) -> Column:
    """Points of a provenance state: 18 if invalid, by trust if an algorithmic origin is declared, 15 for markers alone."""
    known = F.create_map(*[F.lit(x) for k, v in DECLARATIONS.items() for x in (k, v[0])])
    return F.when(state == "invalid", 18.0).when(state == "declared", F.coalesce(F.try_element_at(known, trust), F.lit(0.0))).when(state == "metadata", 15.0).otherwise(0.0)


def structure_points(updates: Column, signed: Column) -> Column:
    """Points of incremental updates: 8 and 3 more each, at most 15, or at most 4 if signed."""
    points = F.least(F.lit(15.0), 8.0 + 3.0 * updates)
    return F.when(updates <= 0, 0.0).when(signed, F.least(F.lit(4.0), points)).otherwise(points)


def rare_fonts(objects: DataFrame) -> DataFrame:
    """Text objects in a rare font among many of a dominant one: (doc_id, page, object_ix, font, text).

    objects: doc_id, page, object_ix, font, font_size, text. Pages of 10 objects, a font of 5, others used at most twice for 1 to 24
    characters of which 55 % are digits, at a size of 4 or more.
    """
    by_font, by_page = Window.partitionBy("doc_id", "page", "font"), Window.partitionBy("doc_id", "page")
    rows = objects.withColumn("uses", F.count("*").over(by_font)).withColumn("total", F.count("*").over(by_page))
    rows = rows.withColumn("most", F.max("uses").over(by_page))
    text = t.trimmed(F.col("text"))
    numeric = F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.lit(1), F.length(text)) >= 0.55
    keep = (F.col("total") >= 10) & (F.col("most") >= 5) & (F.col("uses") <= 2) & F.length(text).between(1, 24) & numeric & (F.col("font_size") >= 4)
    return rows.where(keep).select("doc_id", "page", "object_ix", "font", "text")


def structure_findings(documents: DataFrame) -> DataFrame:
    """(doc_id, code, category, risk_points, confidence, amount) of files' structure.

    documents: doc_id, content (binary), ends array<bigint> (of ``sources.files.revision_ends``), created, modified (raw metadata dates). Byte patterns are
    counted in the content read as ISO-8859-1, where each byte is one character.
    """
    raw = F.decode(F.col("content"), "ISO-8859-1")
    signatures = F.regexp_count(raw, F.lit(r"/(?:FT|Type)\s*/Sig\b"))
    ends = F.coalesce("ends", F.array().cast("array<bigint>"))
    updates = F.greatest(F.lit(0), F.size(ends) - 1)
    after = F.substr(raw, F.try_element_at(ends, F.lit(-1)).cast("int") + 1)
    trailing = F.when(F.size(ends) > 0, F.length(F.regexp_replace(after, r"^[\x00\x09\x0A\x0C\x0D\x20]+|[\x00\x09\x0A\x0C\x0D\x20]+$", ""))).otherwise(0)
    created, modified = dates.pdf_date(F.col("created")), dates.pdf_date(F.col("modified"))
    found = lambda test, code, category, points, confidence, amount: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), points.alias("risk_points"), F.lit(confidence).alias("confidence"), amount.cast("bigint").alias("amount")))
    every = F.array_compact(F.array(
        found(updates > 0, "PDF_INCREMENTAL_UPDATES", "revision_history", structure_points(updates, signatures > 0), 0.95, updates),
        found(modified < created, "PDF_DATE_CONTRADICTION", "metadata", F.lit(15.0), 0.85, F.lit(0)),
        found(trailing > 0, "PDF_TRAILING_DATA", "document_integrity", F.lit(12.0), 0.8, trailing),
    ))
    return documents.select("doc_id", F.inline(every))
