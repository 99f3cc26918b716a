"""File sources: kinds of uploads, page and paragraph text, concept tables, gold sets; JSON sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kind_of(path: Column) -> Column:
    """pdf, docx or empty by the lower-cased extension."""
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx").otherwise("")


def accepted(path: Column) -> Column:
    return kind_of(path) != ""


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def docx_text(content: bytes) -> str:
    """Paragraphs of a docx file joined by line feeds; a docx is a zip with the text in word/document.xml."""
    import io
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def pdf_text(content: bytes) -> str:
    """Page texts, each with a line feed after it, empty pages skipped; needs an optional PDF library."""
    import io

    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional package pdfplumber") from e
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return "".join(t + "\n" for p in pdf.pages if (t := p.extract_text()))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of the files below ``path``: docx and pdf by their kind, other kinds as empty text. A file that can't be read has an error and no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", kind_of(F.col("path")).alias("kind"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c, k in zip(b["path"], b["content"], b["kind"]):
                try:
                    out.append((p, {"docx": docx_text, "pdf": pdf_text}[k](c) if k else "", None))
                except Exception as e:  # one bad file doesn't end the job
                    out.append((p, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.mapInPandas(run, "path string, text string, error string")


def role_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``target``: a name with "jd" in it is the query document, the rest are numbered in sorted order."""
    from pyspark.sql.window import Window as W

    is_jd = F.lower(base_name(F.col(path))).contains("jd")
    number = F.sum(F.when(is_jd, 0).otherwise(1)).over(W.orderBy(path).rowsBetween(W.unboundedPreceding, 0))
    return files.withColumn("target", F.when(is_jd, "jd.pdf").otherwise(F.concat(F.lit("resume_"), number.cast("string"), F.lit(".pdf"))))


def concept_rows(raw: DataFrame) -> DataFrame:
    """preferred_label, alt_labels, concept_uri from a concept table whose headers may be spelled two ways; rows without a label go."""
    names = {c.lower().replace("_", ""): c for c in raw.columns}

    def pick(n: str) -> Column:
        return F.trim(F.col(names[n])) if n in names else F.lit("")

    alts = F.filter(F.transform(F.split(F.translate(F.coalesce(pick("altlabels"), F.lit("")), "|", ";"), ";"), lambda a: F.trim(a)), lambda a: a != "")
    return raw.select(pick("preferredlabel").alias("preferred_label"), alts.alias("alt_labels"), F.coalesce(pick("concepturi"), F.lit("")).alias("concept_uri")).where("preferred_label <> ''")


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    return concept_rows(spark.read.csv(path, header=True, multiLine=True))


def read_gold(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a gold set in one JSON file: requirements, candidates, labels, hand_ranking, alias."""
    raw = spark.read.option("multiLine", "true").json(path)
    out = {k: raw.select(F.explode(k).alias("x")).select("x.*") for k in ("requirements", "candidates", "labels")}
    out["hand_ranking"] = raw.select(F.posexplode("hand_ranking").alias("pos", "slug"))
    alias = raw.select(F.explode(F.from_json(F.to_json("meta.system_skill_alias"), "map<string,array<string>>")).alias("r", "skills"))
    return out | {"alias": alias}


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)
