"""Small tables with the awkward cases every operator has to bear."""

import re

FOLDER = "/root/testdata/sf0.001"
SPACE = "\x20\x09-\x0d"
WORD = re.compile(f"[^{SPACE}]+")

PROSE = (
    "the river bends under old trees while a quiet boat moves past stone walls and open fields where children "
    "watch birds cross the evening sky before lamps are lit along the narrow road that leads from the mill to the "
    "market square and on toward the hills beyond the last farm house where nobody has lived for many years"
)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, copies string, row_key string, figures string"


def documents(spark, rows):
    """(doc_id, text, lang, source) rows beside columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "s", None, "k", "f") for r in rows], DOCS)


def awkward():
    long = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    return [
        (1, PROSE, "en", "src1"),
        (2, PROSE, "en", "src1"),
        (2, PROSE, "en", "src1"),
        (3, None, None, None),
        (4, "", "de", "src2"),
        (5, " \t\n\x0b ", "de", "src2"),
        (None, PROSE + " indeed", None, "src1"),
        (None, None, "en", None),
        (6, long, "en", "src3"),
        (7, long + " tail", "en", "src3"),
        (8, "word", "fr", "odd'source"),
        (9, "ÄÖ straße été año 数据 " * 30, "de", "src1"),
        (10, "12 34 !? ##", "en", "src1"),
    ]
