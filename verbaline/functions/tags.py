"""Tag, coarse-category and dependency dictionaries, predicates over tags, and the coarse-category rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fine tags in label order (label_idx from 0; enum ids are one more, 0 is unknown) with their base category.
TAGS = """
$ SYM
'' PUNCT
, PUNCT
-LRB- PUNCT
-RRB- PUNCT
. PUNCT
: PUNCT
ADD X
AFX ADJ
CC CCONJ
CD NUM
DT DET
EX PRON
FW X
HYPH PUNCT
IN ADP
JJ ADJ
JJR ADJ
JJS ADJ
LS X
MD AUX
NFP PUNCT
NN NOUN
NNP PROPN
NNPS PROPN
NNS NOUN
PDT DET
POS PART
PRP PRON
PRP$ PRON
RB ADV
RBR ADV
RBS ADV
RP PART
SYM SYM
TO PART
UH INTJ
VB VERB
VBD VERB
VBG VERB
VBN VERB
VBP VERB
VBZ VERB
WDT DET
WP PRON
WP$ PRON
WRB ADV
XX X
_SP SPACE
`` PUNCT
"""
LABELS = [tuple(line.split()) for line in TAGS.strip().splitlines()]
#: Coarse categories and dependency relations by id.
UPOS = "ADJ ADP ADV AUX CONJ CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X SPACE".split()
DEPS = """ROOT ACL ACOMP ADVCL ADVMOD AGENT AMOD APPOS ATTR AUX AUXPASS CASE CC CCOMP COMPOUND CONJ CSUBJ CSUBJPASS DATIVE DEP
DET DOBJ EXPL INTJ MARK META NEG NMOD NPADVMOD NSUBJ NSUBJPASS NUMMOD OPRD PARATAXIS PCOMP POBJ POSS PRECONJ PREDET PREP PRT
PUNCT QUANTMOD RELCL XCOMP UNKNOWN""".split()
#: The shipped tag map has GW and lacks XX and _SP; its ids are the sorted order.
SHIPPED = sorted({t for t, _ in LABELS} - {"XX", "_SP"} | {"GW"})

NOUNS, VERBS, WH = ("NN", "NNS", "NNP", "NNPS"), ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ"), ("WDT", "WP", "WP$", "WRB")


def dim_tag(spark: SparkSession) -> DataFrame:
    """tag, pos_tag_id, label_idx, json_id, upos_base; GW, which only the shipped map has, counts as X."""
    at = {t: i for i, t in enumerate(SHIPPED)}
    rows = [(t, i + 1, i, at.get(t), u) for i, (t, u) in enumerate(LABELS)] + [("GW", None, None, at["GW"], "X")]
    return spark.createDataFrame(rows, "tag string, pos_tag_id int, label_idx int, json_id int, upos_base string")


def dim_upos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(UPOS, range(len(UPOS)), strict=True)), "upos string, upos_id int")


def dim_dep(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(DEPS, range(len(DEPS)), strict=True)), "dep string, dep_id int")


def is_noun(tag: Column) -> Column:
    return tag.isin(*NOUNS)


def is_verb(tag: Column) -> Column:
    return tag.isin(*VERBS)


def is_wh_word(tag: Column) -> Column:
    return tag.isin(*WH)


def pick(index: Column, values: list) -> Column:
    """values[index]; null outside."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def upos_base(tag: Column) -> Column:
    """Base category by tag; null for an unknown tag."""
    pairs = reduce(lambda a, b: a + b, ([F.lit(t), F.lit(u)] for t, u in [*LABELS, ("GW", "X")]))
    return F.try_element_at(F.create_map(*pairs), tag)


def resolve_upos(tag: Column, dep: Column, base: Column | None = None) -> Column:
    """Coarse category of a tag under a dependency: verbs that are auxiliaries, determiners that stand alone, else the base."""
    base = upos_base(tag) if base is None else base
    return F.when(is_verb(tag) & dep.isin("AUX", "AUXPASS"), "AUX").when(tag.isin("DT", "WDT") & ~dep.isin("DET", "QUANTMOD"), "PRON").otherwise(base)


def resolve_upos_raw(label_idx: Column, dep_id: Column) -> Column:
    """The same as it was first written: the number is a label index for the base and an enum id for the rules."""
    verbs, determiners = (38, 43), [TAG_ID["DT"], TAG_ID["WDT"]]
    aux = dep_id.isin(DEPS.index("AUX"), DEPS.index("AUXPASS"))
    det = dep_id.isin(DEPS.index("DET"), DEPS.index("QUANTMOD"))
    return F.when(label_idx.between(*verbs) & aux, "AUX").when(label_idx.isin(*determiners) & ~det, "PRON").otherwise(pick(label_idx, [u for _, u in LABELS]))


TAG_ID = {t: i + 1 for i, (t, _) in enumerate(LABELS)}
