"""Korean notices: regions, target tags and the digest verdict as column expressions.

Vocabularies are parameters; the defaults below are those that the rules are defined with.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, bracket_groups, collapse, hits, holds_any, let, normalise_title, strip_brackets

# The vocabularies of the rules.
REGIONS = {
    "서울": ("서울특별시", "서울"), "부산": ("부산광역시", "부산"), "대구": ("대구광역시", "대구"), "인천": ("인천광역시", "인천"), "광주": ("광주광역시", "광주"),
    "대전": ("대전광역시", "대전"), "울산": ("울산광역시", "울산"), "세종": ("세종특별자치시", "세종"), "경기": ("경기도", "경기"), "강원": ("강원특별자치도", "강원"),
    "충북": ("충청북도", "충북"), "충남": ("충청남도", "충남"), "전북": ("전라북도", "전북특별자치도", "전북"), "전남": ("전라남도", "전남"), "경북": ("경상북도", "경북"),
    "경남": ("경상남도", "경남"), "제주": ("제주특별자치도", "제주"),
}
BROAD_REGIONS = ("수도권", "충청", "영남", "호남")
REGION_SUFFIXES = ("센터", "권역", "광역", "특별", "지역", "도", "시", "권")
REGION_PARTICLES = ("에서", "에는", "에도", "에만")
VENUE_CONTEXT = r"(?:개최\s*)?장소\s*[:：][^)\]]*|[가-힣]{2,5}에서\s*[^)\]]{0,10}?(?:개최|진행|열린|열립|열리|실시)|개최지\s*[:：][^)\]]*"
VENUE_WORDS = r"장소|개최|회장|행사장|에서\s*[^)\]]{0,10}?(?:개최|진행|열린|열립|열리|실시)"
COUNCIL_SOURCES = ("kofpi", "forest_service", "forest_press", "fowi", "lawmaking", "coop", "socialenterprise", "seis", "mois_sse", "bizinfo")
OPPORTUNITY = ("공고", "공모", "모집", "신청", "지원사업", "컨설팅", "입주", "입점", "조달", "설명회")
INSTITUTION = ("입법예고", "행정예고", "개정", "시행", "고시", "제도", "정책", "기본계획", "계획", "발표")
INSTITUTION_FIRST = ("입법예고", "행정예고", "고시")
BARE_INSTITUTION = ("계획", "발표")
FOREST = ("산림", "임업", "임산물", "산촌", "목재", "숲", "산지", "임도", "산양삼", "산림복지", "산림치유")
IDENTITY = ("사회적기업", "예비사회적기업", "사회적협동조합", "협동조합", "마을기업", "사회적경제", "사회연대경제", "소셜벤처", "자활기업")
NOISE = ("채용", "합격", "인사발령", "시스템", "서버", "점검", "진로", "체험 부스", "행사 후기", "수상", "선물", "기획전", "카달로그", "카탈로그", "명절", "추석", "청탁금지", "공모결과", "선정 결과", "재난 대비 점검")
CONSUMER = ("참가자", "참가", "체험단", "캠프", "교실", "프로그램 참여", "건강", "출산", "가족", "어린이", "청소년")
BUSINESS = ("기업", "사업자", "단체", "법인", "협동조합", "사회적기업", "마을기업", "업체", "공급자", "입점", "조달", "위탁", "시제품", "배출권", "외부사업", "개발 지원", "인증 지원", "등록")
TAGS = ("사협", "사회적기업", "협동조합", "마을기업", "산림사업자", "전체")
ELIGIBILITY_QUOTES = (
    r"((?:참여|신청|지원|모집)\s*(?:자격|대상)\s*[:：]\s*[^\n]{2,60})",
    r"((?:참여|신청|지원|모집)\s*(?:자격|대상)\s*은?\s+[^\n]{2,60})",
    r"(대상\s*[:：]\s*[^\n]{2,60})",
)
AMOUNT_QUOTES = (r"(최대\s*\d[\d,]*\s*(?:억|천만|백만|만)?\s*원)", r"(\d[\d,]*\s*(?:억|천만|백만|만)\s*원)", r"(\d[\d,]*\s*원\s*(?:이내|한도|지원))")


def _bounded(names: Sequence[str], regions: Mapping[str, Sequence[str]], broad: Sequence[str]) -> str:
    """A pattern of names that end where a region may end: at a boundary, a suffix or another region."""
    others = [*(n for ns in regions.values() for n in ns), *broad]
    after = r"$|\s|[^\p{L}\p{N}]|" + "|".join([*REGION_SUFFIXES, *REGION_PARTICLES, *others]) + r"|에(?![가-힣])"
    return f"(?:{'|'.join(names)})(?={after})"


def region_of(text: Column, regions: Mapping[str, Sequence[str]] = REGIONS, broad: Sequence[str] = BROAD_REGIONS) -> Column:
    """The only region named, else a broad one, else null."""
    found = F.array_compact(F.array(*[F.when(text.rlike(_bounded(names, regions, broad)), F.lit(shown)) for shown, names in regions.items()]))
    wide = F.coalesce(*[F.when(text.rlike(_bounded([b], regions, broad)), F.lit(b)) for b in broad])
    return let({"found": found}, lambda v: F.when(F.size(v["found"]) == 1, F.get(v["found"], F.lit(0))).otherwise(wide))


def infer_region(title: Column, **vocabulary) -> Column:
    """The region a notice is for: of its bracket groups the first that names one (venues don't count), else of the rest."""
    groups = F.filter(bracket_groups(title), lambda g: ~g.rlike(VENUE_WORDS))
    named = F.filter(F.transform(groups, lambda g: region_of(g, **vocabulary)), lambda r: r.isNotNull())
    rest = collapse(F.regexp_replace(strip_brackets(title), VENUE_CONTEXT, " "))
    return let({"rest": rest}, lambda v: F.coalesce(F.get(named, F.lit(0)), region_of(v["rest"], **vocabulary)))


def target_tags(text: Column) -> Column:
    """Who a notice is for, in a fixed order; 'all' only if nobody else is named."""
    coop = F.contains(text, F.lit("사회적협동조합"))
    tests = (coop, holds_any(text, ("사회적기업", "소셜벤처")), F.contains(F.replace(text, F.lit("사회적협동조합"), F.lit("")), F.lit("협동조합")), F.contains(text, F.lit("마을기업")), holds_any(text, FOREST))
    tags = F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in zip(TAGS, tests)]))
    every = F.when(holds_any(text, ("사회적경제", "사회연대경제")), F.array(F.lit(TAGS[-1]))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(tags) > 0, tags).otherwise(every)


def target_display(tags: Column, region: Column) -> Column:
    return F.concat(F.array_join(tags, "·"), F.when(region.isNotNull(), F.concat(F.lit("("), region, F.lit(")"))).otherwise(""))


@dataclass(frozen=True)
class Verdict:
    """One rule: its verdict, condition, reason, and where a held notice goes if it is pinned."""

    name: str
    condition: Column
    reason: Column
    pin: Column | None = None
    shows: bool = field(default=True)


def classify(title: Column, summary: Column, source: Column, pool: Sequence[str] = COUNCIL_SOURCES) -> Column:
    """struct(verdict, reason, matched, tags, region, pin_section) of a notice by an ordered rule list."""
    none = F.array().cast("array<string>")

    def words(a: Column) -> Column:
        text = F.trim(F.concat_ws(" ", a["t"], a["s"]))
        return let({"t": a["t"], "text": text}, lambda v: let({"t": v["t"], "forest": hits(v["text"], FOREST), "identity": hits(v["text"], IDENTITY), "tags": target_tags(v["text"]), "region": infer_region(v["t"])}, found))

    def found(v: Column) -> Column:
        t = v["t"]
        held = {"relevance": F.concat(v["forest"], v["identity"]), "opportunity": hits(t, OPPORTUNITY), "institution": hits(t, INSTITUTION), "noise": hits(t, NOISE), "first": hits(t, INSTITUTION_FIRST), "consumer": hits(t, CONSUMER)}
        flags = {"known": holds_any(t, IDENTITY), "business": holds_any(t, BUSINESS), "tags": v["tags"], "region": v["region"]}
        return let(held | flags, judged)

    def judged(v: Column) -> Column:
        relevance, opportunity, noise, first, consumer, tags, region = (v[k] for k in ("relevance", "opportunity", "noise", "first", "consumer", "tags", "region"))
        some = lambda a: F.size(a) > 0
        why = lambda text, a: F.concat(F.lit(text), F.get(a, F.lit(0)))
        relevant = some(relevance)
        bare = F.array(*[F.lit(w) for w in BARE_INSTITUTION])
        institution = F.when(relevant, v["institution"]).otherwise(F.array_except(v["institution"], bare))
        pin = F.when(some(first), "notice").when(some(opportunity), "apply").otherwise("notice")
        rules = [
            (Verdict("exclude", ~F.coalesce(source.isin(*pool), F.lit(False)) & ~v["known"], F.lit("협의회 소스 풀 외"), shows=False), none),
            (Verdict("hold", some(noise) & relevant & (some(opportunity) | some(institution)), why("노이즈 의심: ", noise), pin), F.concat(relevance, noise)),
            (Verdict("exclude", some(noise), why("노이즈: ", noise), shows=False), noise),
            (Verdict("exclude", ~relevant, F.lit("관련성 없음"), shows=False), none),
            (Verdict("hold", ~some(tags), F.lit("대상 태그 없음"), pin, shows=False), relevance),
            (Verdict("notice", some(first), why("제도: ", first)), F.concat(relevance, institution)),
            (Verdict("hold", some(opportunity) & some(consumer) & ~v["business"], why("참가자 모집(B2C): ", consumer), F.lit("apply")), F.concat(relevance, opportunity, consumer)),
            (Verdict("apply", some(opportunity), why("기회: ", opportunity)), F.concat(relevance, opportunity)),
            (Verdict("notice", some(institution), why("제도: ", institution)), F.concat(relevance, institution)),
        ]
        out = F.struct(F.lit("hold").alias("verdict"), F.lit("섹션 판정 불명").alias("reason"), relevance.alias("matched"), tags.alias("tags"), region.alias("region"), F.lit("notice").alias("pin_section"))
        for rule, matched in reversed(rules):
            shown = (tags, region) if rule.shows else (none, F.lit(None).cast("string"))
            row = F.struct(F.lit(rule.name).alias("verdict"), rule.reason.alias("reason"), matched.alias("matched"), shown[0].alias("tags"), shown[1].alias("region"), (rule.pin if rule.pin is not None else F.lit(None).cast("string")).alias("pin_section"))
            out = F.when(rule.condition, row).otherwise(out)
        return out

    return let({"t": normalise_title(title), "s": normalise_title(summary)}, words)


def quoted(text: Column, patterns: Sequence[str], otherwise: str = "원문 확인") -> Column:
    """The first match of the first pattern that matches."""
    return F.coalesce(*[F.nullif(collapse(F.regexp_extract(blank(text), p, 1)), F.lit("")) for p in patterns], F.lit(otherwise))


def monthly_rule(title: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """The first rule one of whose words the title holds, null for none."""
    out = F.lit(None).cast("string")
    for name, ws in reversed(list(rules.items())):
        out = F.when(holds_any(title, ws), F.lit(name)).otherwise(out)
    return out
