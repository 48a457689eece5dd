"""Language codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 639-1 codes, each with its ISO 639-2 codes.
CODES = """
af afr; ar ara; be bel; bg bul; bn ben; ca cat; cs cze ces; cy wel cym; da dan; de ger deu; el gre ell; en eng; es spa; et est;
eu baq eus; fa per fas; fi fin; fr fre fra; gl glg; he heb; hi hin; hr hrv; hu hun; hy arm hye; id ind; is ice isl; it ita; ja jpn;
ka geo kat; kk kaz; ko kor; lt lit; lv lav; mk mac mkd; mr mar; ms may msa; ne nep; nl dut nld; no nor; pl pol; pt por; ro rum ron;
ru rus; sk slo slk; sl slv; sr srp; sv swe; sw swa; ta tam; th tha; tl tgl; tr tur; uk ukr; ur urd; vi vie; zh chi zho
"""
TO_PART1 = {code: group.split()[0] for group in CODES.split(";") for code in group.split()}


def to_part1(c: Column) -> Column:
    """The ISO 639-1 code of a part-1 or part-2 code; null if it isn't known."""
    known = F.create_map(*[F.lit(x) for pair in sorted(TO_PART1.items()) for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")))


def language_matches(languages: Column, want: Column) -> Column:
    """Whether an array of codes holds the wanted language; one that isn't known is compared as it is, case aside."""
    part1 = to_part1(want)
    known = F.exists(languages, lambda x: to_part1(x) == part1)
    literal = F.exists(languages, lambda x: F.lower(x) == F.lower(want))
    return F.coalesce(F.when(part1.isNotNull(), known).otherwise(literal), F.lit(False))
