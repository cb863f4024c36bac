"""Hidden-text idioms in markup and style sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.operators.scan import any_of

# Fixed values: (name, pattern, severity in markup, severity in style sheets).
IDIOMS = [
    ("HIDDEN_STYLE_ZERO_FONT", r"font-size\s*:\s*0(?:\.0+)?(?:px|pt|em|rem|%)?(?![\w.])", "warning", "info"),
    ("HIDDEN_STYLE_TRANSPARENT", r"color\s*:\s*transparent", "warning", "info"),
    ("HIDDEN_STYLE_SAME_COLOR", r"color\s*:\s*(#[0-9a-f]{3,8})\s*;\s*background(?:-color)?\s*:\s*\1", "warning", "warning"),
    ("HIDDEN_STYLE_OPACITY_ZERO", r"opacity\s*:\s*0(?:\.0+)?(?![\d.])", "warning", "info"),
    ("HIDDEN_STYLE_DISPLAY_NONE", r"display\s*:\s*none", "info", "info"),
    ("HIDDEN_STYLE_VISIBILITY", r"visibility\s*:\s*(?:hidden|collapse)", "info", "info"),
    ("HIDDEN_STYLE_OFFSCREEN_INDENT", r"text-indent\s*:\s*-\d{3,}(?:px|em|rem)", "warning", "info"),
    ("HIDDEN_STYLE_HIDDEN_ATTR", r'<\w+[^>]*\s(?:hidden|aria-hidden\s*=\s*"true")[\s>]', "info", "info"),
    ("HIDDEN_STYLE_CLIP", r"clip(?:-path)?\s*:\s*(?:rect\(\s*0(?:px)?[,\s]+0(?:px)?[,\s]+0(?:px)?[,\s]+0(?:px)?\s*\)|inset\(\s*50%\s*\))", "info", "info"),
]
MARKUP = [".html", ".htm", ".svg", ".md", ".xml"]


def find_hidden_styles(df: DataFrame, extension: Column, text: str = "text") -> DataFrame:
    """A row per match; ``extension`` says whether a text is markup, a style sheet, or neither (no rows)."""
    wanted = df.withColumn("_css", extension == ".css").filter(extension.isin(*MARKUP, ".css"))
    rows = any_of(wanted, [(f"(?i){pattern}",) for _, pattern, _, _ in IDIOMS], text)
    by_rule = lambda values: F.get(F.lit(values), F.col("rule"))
    severity = F.when(F.col("_css"), by_rule([css for *_, css in IDIOMS])).otherwise(by_rule([markup for *_, markup, _ in IDIOMS]))
    rows = rows.withColumns({
        "name": by_rule([name for name, *_ in IDIOMS]), "category": F.lit("markup"), "severity": severity,
        "safety": F.lit("ambiguous"), "fix": F.lit("review"), "code_point": F.lit(None).cast("long"), "utf8_hex": F.lit(None).cast("string"),
    })
    return rows.withColumn("severity_rank", F.when(F.col("severity") == "warning", 2).otherwise(1)).drop("_css", "rule")
