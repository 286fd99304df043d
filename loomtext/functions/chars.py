"""Character classes as pieces of Java regular expressions. Their ranges are fixed values; they differ on purpose."""

IDEOGRAPH = r"\u3400-\u9FFF"
KANA_HANGUL = r"\u3040-\u30FF\uAC00-\uD7AF"
#: Ideographs, kana and hangul.
FAMILY = IDEOGRAPH + KANA_HANGUL
#: The narrower range of the speech normaliser and the bilingual checks.
BASIC_IDEOGRAPH = r"\u4E00-\u9FFF"

TIGHT_PUNCTUATION = "，。！？、；：,.!?;:"
OPENING = "（【《「『"
CLOSING = "）」』】》"
SPEECH_PUNCTUATION = "。，！？、：；"
#: As inside a class: brackets and the hyphen are escaped.
OVERLAP_PUNCTUATION = r",.;:!?，。！？、；：()\[\]{}\"'“”‘’"
QUALITY_PUNCTUATION = OVERLAP_PUNCTUATION + "`"

#: White space of Unicode, as a class that Java reads with the flag U.
SPACE = r"(?U)\s"
