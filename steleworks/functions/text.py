"""Text functions as column expressions; everything but slugs with accents stays in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# What the cleaning of transcripts matches.
ILLEGIBLE = r"\(판독불가\)|[▦▧△▼◆○◦◯☐□■？]"
MARK = "▨"
REMOVED = (
    r"[ㄱ-ㅎ가-힣0-9\[\]\(\)【】〔〕『』｢｣·,…\?\/\:''「․（）［］\.〈〉◎;!"
    r"\"\'\*\+@\{\}⃞▩、《》ㅜㅡㅣㆍ"
    r"#%&<=>ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    r"\\_`abcdefghijklmnopqrstuvwxyz|~"
    r"€×íāīŚśū˅᠁ṃṅṇṣṭ"
    r"–—―‥※ⅠⅡⅢ→↩∕∘∙∧∨∴⊏⊐⊙⎀"
    r"①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑴⑵"
    r"─━│┃┌┎┏┒┓└┗┘┛├┠┤┥┲╋▣☔❍⬜"
    r"おけこしせそてとにのみるを"
    r"アイシジスセタテデトナニノハホマリヲ・"
    r"㈠㈡㈢㉠㉡㉢㉣㉤㉥"
    r"」☆"
    "\u200b\u0080\ufeff"
    r"-]"
)
NOISE = ["譯註", "韓國金石", "高麗靑瓷", "調査報告", "側銘", "小口銘", "金石文", "全文", "遺文"]
# The white space of Unicode, without and with the line feed, as classes.
BLANK = "[\\t\\x0B\\f\\r \\x1c-\\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE = BLANK[:-1] + r"\n]"
# Character ranges.
CJK = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u2e80-\u2fd5"
HANGUL = "\uac00-\ud7a3\u1100-\u11ff\u3130-\u318f"
#: Removes what is neither letter nor space from texts in Latin script, as REMOVED does for transcripts.
LATIN_REMOVED = r"[0-9\[\]\(\)·,…\?\/\:'.;!\"\*\+@\{\}#%&<=>\\_|~-]"
# Faces of a stone in captions, first match wins, and captions that stand for themselves.
FACES = [(r"(?:앞|전|정)면", "앞면"), (r"(?:뒷|후)면", "뒷면"), (r"(?:오른|우)(?:쪽|측)?면", "오른쪽면"), (r"(?:왼|좌)(?:쪽|측)?면", "왼쪽면"), (r"(?:윗|위|상)면", "윗면"), (r"(?:아랫|아래|하|밑)면", "아랫면")]
CAPTIONS = ["명문", "비문"]
# Punctuation by the mark that stands for it, in order of priority.
REDUCED = {"?": "?", "。": "!.;。", ",": ",-/:|·、"}
SPACED = "!:,?。"
FINAL = "[최종 번역]"
EMPTY = "[EMPTY]"
# Characters that don't count for the vocabulary.
UNCOUNTED = [" ", ",", "。", ".", "\n", "\t"]


def mask_illegible(c: Column) -> Column:
    return F.regexp_replace(c, ILLEGIBLE, MARK)


def strip_class(c: Column, pattern: str = REMOVED) -> Column:
    """Without the characters of a class.

    Java's matcher goes through a large class member by member, but holds single Latin
    characters in a bit set: those of ASCII go first, as a class of their own, and what the
    class can't hold is kept from the long way by a range in front.
    """
    one = re.compile(pattern)
    plain = "".join(f"\\x{i:02x}" for i in range(128) if one.fullmatch(chr(i)))
    out = F.regexp_replace(c, f"[{plain}]+", "") if plain else c
    han = "" if any(one.fullmatch(chr(i)) for i in range(0x4E00, 0xA000)) else "\u4e00-\u9fff"
    return F.regexp_replace(out, f"[[^\\x00-\\x7f{han}]&&{pattern}]+", "")


def drop_noise(c: Column) -> Column:
    return F.regexp_replace(c, "|".join(map(re.escape, NOISE)), "")


def strip(c: Column) -> Column:
    """Without white space of Unicode at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def tidy_lines(c: Column) -> Column:
    """Runs of blanks as one, none around line feeds, none at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, f"{BLANK}+", " "), " *\n *", "\n"))


def flatten(c: Column) -> Column:
    """One line: runs of white space as one space; null gives the empty text."""
    return F.coalesce(strip(F.regexp_replace(c, f"{SPACE}+", " ")), F.lit(""))


def clean(c: Column, removed: str = REMOVED) -> Column:
    """Masked, stripped of the class, without noise words and tidied, in this order; null gives the empty text."""
    return F.coalesce(tidy_lines(drop_noise(strip_class(mask_illegible(c.cast("string")), removed))), F.lit(""))


def cjk_ratio(c: Column, ranges: str = CJK) -> Column:
    """Share of CJK characters among those that aren't spaces; 0.0 without any."""
    size = F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(size > 0, F.length(F.regexp_replace(c, f"[^{ranges}]", "")) / size).otherwise(F.lit(0.0))


def has_hangul(c: Column) -> Column:
    return c.rlike(f"[{HANGUL}]")


def slug_ascii(c: Column) -> Column:
    """Slug of a text in ASCII; other characters separate."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^\x00-\x7f]", ""), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


@pandas_udf(StringType())
def slug(s: pd.Series) -> pd.Series:
    """Slug after compatibility decomposition, which Spark has no function for."""

    def one(x):
        if x is None:
            return None
        plain = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()
        return "_".join(re.findall("[A-Za-z0-9]+", plain)).lower()

    return s.map(one)


def caption(c: Column) -> Column:
    """The face that a caption names, one of CAPTIONS, or null."""
    x = F.regexp_replace(F.regexp_replace(flatten(c), "[·•∙‧]", ""), r"[\d０-９①-⑳()\[\].]", "")
    out = F.when((F.length(c) > 25) | (F.length(c) == 0) | (x == ""), F.lit(None).cast("string"))
    for pattern, label in FACES:
        out = out.when(x.rlike(pattern), label)
    return out.when(x.isin(*CAPTIONS), x)


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{P}\p{Z}]", "")


def reduce_punctuation(c: Column) -> Column:
    """The most frequent of the three marks that punctuation is reduced to; ties by their order; '' without any."""
    counts = [(mark, F.length(c) - F.length(F.translate(c, own, ""))) for mark, own in REDUCED.items()]
    most = F.greatest(*[n for _, n in counts])
    out = F.when(most <= 0, "")
    for mark, n in counts:
        out = out.when(n == most, mark)
    return out


def space_after(c: Column, chars: str = SPACED) -> Column:
    return F.regexp_replace(c, f"([{re.escape(chars)}])", "$1 ")


def final_translation(c: Column) -> Column:
    """The first line after the marker of a model's output, the marker with a colon first; the whole output without one."""
    out = None
    for marker in (FINAL + ":", FINAL):
        found = F.split_part(strip(F.split_part(c, F.lit(marker), F.lit(2))), F.lit("\n"), F.lit(1))
        out = F.when(F.contains(c, F.lit(marker)), found) if out is None else out.when(F.contains(c, F.lit(marker)), found)
    return out.otherwise(c)


def drop_glosses(c: Column) -> Column:
    return flatten(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*[一-鿿][^)]*\)", ""))


def noun_candidates(c: Column) -> Column:
    """Hangul words outside of brackets: what a tagger gets; without one, its stand-in."""
    return flatten(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", " "), r"[^가-힣\s]", ""))


def plain_masks(c: Column) -> Column:
    return F.regexp_replace(c, r"\[MASK\d+\]", "[MASK]")


def first_group(c: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def joined_lines(*parts: Column) -> Column:
    """Non-empty parts as lines; EMPTY without any."""
    return F.coalesce(F.nullif(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n"), F.lit("")), F.lit(EMPTY))


def url_suffix(c: Column, default: str = ".jpg") -> Column:
    return F.coalesce(first_group(F.regexp_replace(F.regexp_replace(c, "[?#].*$", ""), "^[a-z]+://[^/]*", ""), r"(\.[^./]+)$"), F.lit(default))
