"""Scalar normalisers as Column expressions: messy source strings to numbers, dates, cities, names and classes.

All take a Column and give a Column; none is a UDF. Blank means null or ''.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of provinces, classes in order with their keywords, organisation types in order.
PROVINCES = "内蒙古 广西 西藏 宁夏 新疆 河北 山西 辽宁 吉林 黑龙江 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 海南 四川 贵州 云南 陕西 甘肃 青海".split()
INDUSTRY_CLASSES = {
    "机械和设备": "机械 机床 设备 五金 工业 铸造 冶金 模具 橡塑 塑料 橡胶 包装 印刷 制冷 暖通 泵阀 紧固件 电缆 电力 新能源 能源 电动车 汽车 汽配 车展 摩托车 自行车 玻璃 复合材料 纺织工业 纺织印花 染料 非开挖 建材 建筑 分析测试仪器 仪器 安防 劳保".split(),
    "休闲": "休闲 旅游 体育 户外 房车 露营 游艇 船艇 钓鱼 玩具 宠物 花卉 园艺 景观 礼品 珠宝 文具 教育 乐器 文化".split(),
    "生活方式": "生活 消费 食品 糖酒 餐饮 烘焙 茶 咖啡 酒 饮料 服装 纺织 家纺 家居 家电 家具 孕婴童 个人护理 美容美发 化妆品 奢侈品 品牌授权 光学眼镜 成人用品 连锁加盟".split(),
    "科技+": "科技 电子 消费电子 半导体 显示 AI 人工智能 互联网 物联网 大数据 通信 5G 软件 信息 数字 无人驾驶 无人机 无人系统 灯光 照明 广告标识 直播电商".split(),
    "医疗和健康": "医疗 健康 医 药 制药 口腔 牙科 康复 养老 银发 保健 医疗器械 生物".split(),
    "零售贸易和服务": "零售 贸易 服务 物流 连锁 商业 加盟 消费品".split(),
}
ORGANISATION_TYPES = {
    "组委会": r"组委会|组织委员会|办公室$|执委会",
    "政府": r"人民政府|商务部|工信部|科技部|科学技术部|发改委|发展和改革委员会|工业和信息化部|农业农村|文化和旅游|中华人民共和国|市委|省委|办公厅|管委会|政府|东盟秘书处|联合国|国家电网|广域市|部$|[厅局]$",
    "协会": r"协会|学会|商会|联合会|促进会|理事会|联盟|工会|研究会|基金会|贸促会|学院|大学|研究院|中国科学院|中国工程院|委员会|总会|专委会|中心$",
    "企业": r"(?iU)有限公司|股份|集团|公司|展览|会展|博览|电视台|传媒|控股|\bLtd\b|\bLLC\b|\bInc\b|\bGmbH\b|\bCorp|\bCo\.|Exhibition|Expo|Fair|Messe|Media|Events|Group|\bPte\b|\bPvt\b|S\.A|S\.p\.A|Promotion|Communications",
}
OTHER_TYPE = "其他"
SCALE_BUCKETS = (("lt1w", 0, 10_000), ("1w-5w", 10_000, 50_000), ("5w-10w", 50_000, 100_000), ("gte10w", 100_000, None))
_HAN = "一-鿿"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that isn't blank, else ''."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def parse_numeric(c: Column) -> Column:
    """'面积:10.5万平方米' -> 105000. A label up to the last colon before a digit goes; N万 is N times ten thousand,
    rounded half to even; else the first run of digits and commas. Null if there is none."""
    s = F.regexp_replace(F.trim(c), r"^[^\d]*[:：]\s*", "")
    plain = lambda x: F.regexp_replace(x, "[,，]", "")
    wan = F.regexp_extract(s, r"([\d,，]+\.?\d*)\s*万", 1)
    digits = F.regexp_extract(s, r"([\d,，]+)", 1)
    in_wan = F.bround(plain(wan).try_cast("double") * 10_000).cast("long")
    return F.when(wan != "", in_wan).when(digits != "", plain(digits).try_cast("long"))


def _iso(year: Column, month: Column, day: Column) -> Column:
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat_ws("-", year, two(month), two(day))


def parse_date_pair(c: Column) -> Column:
    """struct(start, end) of ISO strings. A range that ends in an earlier month ends in the next year; no calendar check."""
    s = F.trim(c)
    dot = r"(\d{4})[.\-](\d{1,2})[.\-](\d{1,2})"
    span = rf"^{dot}\s*[-–]\s*(\d{{1,2}})[.\-](\d{{1,2}})"
    days = rf"^{dot}\s*[-–]\s*(\d{{1,2}})$"
    han = r"^(\d{4})年(\d{1,2})月(\d{1,2})日"
    han_span = han + r"[~\-–至](\d{1,2})月(\d{1,2})日"

    def g(pattern: str, i: int) -> Column:
        return blank_to_null(F.regexp_extract(s, pattern, i))

    def ranged(pattern: str) -> Column:
        y, sm, sd, em, ed = (g(pattern, i) for i in range(1, 6))
        later = (y.cast("int") + F.when(em.cast("int") < sm.cast("int"), 1).otherwise(0)).cast("string")
        return F.struct(_iso(y, sm, sd).alias("start"), _iso(later, em, ed).alias("end"))

    def single(pattern: str) -> Column:
        return F.struct(_iso(*(g(pattern, i) for i in (1, 2, 3))).alias("start"), F.lit(None).cast("string").alias("end"))

    same_month = F.struct(_iso(g(days, 1), g(days, 2), g(days, 3)).alias("start"), _iso(g(days, 1), g(days, 2), g(days, 4)).alias("end"))
    none = F.struct(F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"))
    return (
        F.when(s.rlike(span), ranged(span)).when(s.rlike(days), same_month).when(s.rlike(f"^{dot}$"), single(dot))
        .when(s.rlike(han_span), ranged(han_span)).when(s.rlike(han), single(han)).otherwise(none)
    )


def normalize_city(c: Column) -> Column:
    """'上海上海' -> '上海', '湖北武汉' -> '武汉'."""
    s = F.trim(F.coalesce(c, F.lit("")))
    four, head, tail = F.char_length(s) == 4, F.substring(s, 1, 2), F.substring(s, 3, 2)
    return F.when(four & (head == tail), head).when(four & head.isin(PROVINCES), tail).otherwise(s)


def canonical_url(c: Column) -> Column:
    """Without .htm(l) and slashes at the end of the path; the query stays."""
    path, query = F.split_part(c, F.lit("?"), F.lit(1)), F.regexp_extract(c, r"(?s)(\?.*)$", 1)
    return F.when(blank_to_null(c).isNull(), "").otherwise(F.concat(F.regexp_replace(path, r"(?i)(?:\.html?)?/*$", ""), query))


def normalize_cjk_spaces(c: Column) -> Column:
    """No blanks between two Han characters, single ones elsewhere."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"(?<=[{_HAN}])\s+(?=[{_HAN}])", ""), r"\s+", " "))


def normalize_name(c: Column) -> Column:
    """A fair's name without years, edition numbers, city brackets, blanks and punctuation."""
    steps = ((r"20[2-9]\d\s*年?", ""), (r"第\s*[一二三四五六七八九十百千零〇两\d]+\s*届", ""), (r"[（(][^）)]*[市省][^）)]*[）)]", ""), (r"(?U)\s+", ""), (r"[（()）\-,、，·]", ""))
    return F.trim(reduce(lambda s, p: F.regexp_replace(s, *p), steps, F.coalesce(c, F.lit(""))))


def norm_en(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")


def company_key(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"[^0-9a-zA-Z{_HAN}]", "")


def classify_organisation(c: Column) -> Column:
    """The first type whose pattern is found."""
    return reduce(lambda rest, x: F.when(c.rlike(x[1]), x[0]).otherwise(rest), reversed(ORGANISATION_TYPES.items()), F.lit(OTHER_TYPE))


def normalize_corp_name(c: Column) -> Column:
    """Company name without empty brackets, legal suffix and country prefix; the original if nothing would be left."""
    t = F.regexp_replace(F.trim(c), r"[（(]\s*[)）]", "")
    t = F.regexp_replace(t, r"(股份)?(有限)?(责任)?公司$", "")
    t = F.trim(F.regexp_replace(t, r"^(德国|法国|英国|美国|日本|韩国|意大利|西班牙|荷兰|波兰|土耳其|印度|俄罗斯)", ""))
    return F.coalesce(blank_to_null(t), c)


def keyword_class(c: Column, classes: dict[str, list[str]], default: str = "") -> Column:
    """The first class, in order, with a keyword that the text contains."""
    pairs = F.array(*[F.struct(F.lit(k).alias("c"), F.lit(w).alias("w")) for k, words in classes.items() for w in words])
    hit = F.get(F.filter(pairs, lambda p: F.contains(F.coalesce(c, F.lit("")), p["w"])), F.lit(0))
    return F.coalesce(hit["c"], F.lit(default))


def classify_industry(c: Column) -> Column:
    return keyword_class(c, INDUSTRY_CLASSES)


def embedded_english(c: Column) -> Column:
    """English at the end of a name, else in brackets, else an abbreviation; null if none."""
    tail = F.regexp_extract(c, r"([A-Z][A-Za-z0-9\s&,-]{3,})$", 1)
    inside = F.regexp_extract(c, r"[（(]([A-Z][A-Za-z\s&-]{2,})[）)]", 1)
    short = F.regexp_extract(c, r"(?<![A-Za-z0-9_])([A-Z]{2,10})(?![A-Za-z0-9_])", 1)
    return F.coalesce(*[blank_to_null(F.trim(x)) for x in (tail, inside, short)])


def generated_english(c: Column) -> Column:
    """An English name for a Chinese one: what stands in brackets, else the core word, else the first part, with EXPO."""
    name = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^\d{4}", ""), r"^(?:第\d+届)", "")
    inside = F.trim(F.regexp_extract(name, r"[（(]([A-Za-z\s/]{2,})[）)]", 1))
    core = F.trim(F.regexp_extract(name, r"(?:国际|中国)?(.{2,10})(?:展览会|博览会|展|大会|峰会|交易会)", 1))
    part = F.get(F.filter(F.split(name, r"[、，,&\s]"), lambda s: F.char_length(s) >= 2), F.lit(0))
    return F.when(inside != "", inside).when(core != "", F.concat(core, F.lit(" EXPO"))).when(part.isNotNull(), F.concat(part, F.lit(" EXPO"))).otherwise("")


def is_english(c: Column) -> Column:
    """Blank or without Han characters."""
    return ~F.coalesce(c, F.lit("")).rlike(f"[{_HAN}]")


def english_after_han(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, rf"(?s).*[{_HAN}](.*)$", 1))


def year_before_dot(c: Column) -> Column:
    return F.coalesce(F.split_part(c, F.lit("."), F.lit(1)).try_cast("int"), F.lit(0))


def first_year(c: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(c, r"(\d{4})", 1)).cast("int"), F.lit(0))


def scale_bucket(c: Column) -> Column:
    """The key of the half-open size range; null for null."""
    out = F.lit(SCALE_BUCKETS[-1][0])
    for key, _, below in reversed(SCALE_BUCKETS[:-1]):
        out = F.when(c < below, key).otherwise(out)
    return F.when(c.isNotNull(), out)


def source_lattice(old: Column, new: Column, a: str, b: str, manual: tuple[str, ...]) -> Column:
    """Where a row's data come from after one more source: manual stays, a and b become a+b."""
    pair = F.lit(f"{a}+{b}")
    both = ((old == a) & (new == b)) | ((old == b) & (new == a)) | (old == pair)
    return F.when(old.isin(*manual), old).when(blank_to_null(old).isNull(), new).when(blank_to_null(new).isNull(), old).when(both & new.isin(a, b), pair).otherwise(new)


def period(start: Column, end: Column) -> Column:
    """'2026-05-01' and '2026-05-03' as '2026-05-01~05-03'."""
    tail = F.when(F.substring(start, 1, 4) == F.substring(end, 1, 4), F.substring(end, 6, 5)).otherwise(end)
    return F.when(blank_to_null(start).isNull(), "").when(blank_to_null(end).isNull() | (start == end), start).otherwise(F.concat(start, F.lit("~"), tail))


def month_range(month: Column) -> Column:
    """struct(first, last) of ISO days of 'yyyy-MM'."""
    first = F.to_date(F.concat(month, F.lit("-01")))
    return F.struct(first.cast("string").alias("first"), F.last_day(first).cast("string").alias("last"))


def shift_month(month: Column, by: int) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), by), "yyyy-MM")


def end_of_week(day: Column) -> Column:
    """The Sunday of the day's week, weeks starting on Monday."""
    return F.date_add(day, 6 - F.weekday(day))


def calendar_time(moment: Column) -> Column:
    return F.when(F.char_length(moment) > 10, F.substring(moment, 12, 5))


def format_number(c: Column) -> Column:
    """Large counts in 亿 and 万, others with thousands separators."""
    return F.when(c.isNull(), "-").when(c >= 10**8, F.concat(F.format_number(c / 10**8, 1), F.lit("亿"))).when(c >= 10**4, F.concat(F.format_number(c / 10**4, 1), F.lit("万"))).otherwise(F.format_number(c, 0))


def slugify(c: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w]+", "_"), "^_+|_+$", ""), 1, most)


def enum_label(c: Column, labels: dict[str, str], dash: str = "—") -> Column:
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else None
    return F.when(blank_to_null(c).isNull(), dash).otherwise(F.coalesce(F.try_element_at(known, c), c) if labels else c)


def stage_index(c: Column, stages: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, stages)), c).cast("int") - 1


def minutes_between(start: Column, end: Column) -> Column:
    return F.round((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60).cast("long")


def excerpt(c: Column, most: int = 160) -> Column:
    return F.substring(c, 1, most)


def tolerant_json(c: Column) -> Column:
    """The text if it is JSON, else '{}'."""
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise("{}")


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


def is_safe_path(c: Column, roots: tuple[str, ...]) -> Column:
    """Relative, under an allowed root, no step upwards, no hidden parts, no backslash or NUL."""
    parts = F.split(c, "/")
    bad = F.exists(parts, lambda p: (p == "") | p.startswith(".") | p.contains("\\") | p.contains("\0"))
    return blank_to_null(c).isNotNull() & ~c.startswith("/") & ~bad & F.get(parts, F.lit(0)).isin(*roots)


def request_token(key: Column, moment: Column, secret: Column) -> Column:
    return F.upper(F.md5(F.concat(key, moment, secret)))


def booth(hall: Column, number: Column) -> Column:
    return F.trim(F.concat(F.coalesce(hall, F.lit("")), F.lit(" "), F.coalesce(number, F.lit(""))))


def dedupe_list(c: Column, separator: str = "+") -> Column:
    return F.array_join(F.array_distinct(F.filter(F.split(c, f"\\Q{separator}\\E"), lambda x: x != "")), separator)


def asset_url(c: Column, base: str) -> Column:
    return F.when(c.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|/|#)"), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(c, r"^\./", "")))


def stage_event_text(c: Column, labels: dict[str, str]) -> Column:
    """'a → b' with the labels of both stages."""
    sides = F.transform(F.split(c, "→"), lambda s: enum_label(F.trim(s), labels))
    return F.when(c.contains("→"), F.array_join(sides, " → ")).otherwise(c)


def one_line(c: Column) -> Column:
    """A JSON object's fields as 'key value · key value', blanks left out."""
    fields = F.from_json(c, "map<string,string>")
    filled = F.map_filter(fields, lambda k, v: blank_to_null(v).isNotNull())
    return F.array_join(F.transform(F.array_sort(F.map_entries(filled)), lambda e: F.concat_ws(" ", e["key"], e["value"])), " · ")


def tender_row(c: Column) -> Column:
    """struct(title, bidder, amount, day) of a tender's JSON, whichever of its keys are used."""
    get = lambda *paths: F.coalesce(*[blank_to_null(F.get_json_object(c, p)) for p in paths], F.lit(""))
    place = get("$.Province", "$.Area")
    bidder = get("$.Bidders[0].Name", "$.WinBidder[0].Name", "$.Bidder")
    return F.struct(
        F.substring(get("$.Title", "$.ProjectName"), 1, 50).alias("title"),
        F.substring(F.when((bidder != "") & (place != ""), F.concat(bidder, F.lit("("), place, F.lit(")"))).otherwise(bidder), 1, 35).alias("bidder"),
        get("$.Amount", "$.BidAmount", "$.Budget").alias("amount"), get("$.PublishDate", "$.PubDate").alias("day"),
    )
