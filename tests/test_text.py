"""Text, title and rule expressions on hand-made Chinese examples."""

import random
import re

import pytest
from pyspark.sql import functions as F

from jobpanel.functions import fixed, quality, segment, skills, text, titles, urls
from jobpanel.operators import cleaning


def test_strip_html_decodes_before_removing_tags(one):
    assert one(text.strip_html, "<p>A&nbsp;&amp; B</p>&lt;br&gt;  C") == "A & B C"
    assert one(text.strip_html, "&amp;lt;b") == "&lt;b"


@pytest.mark.parametrize("raw,want", [
    ("C/C++ 和 C#，.NET，TCP/IP", "c_cpp 和 csharp，dotnet，tcpip"), ("Node.js O2O", "nodejs otoo")])
def test_symbol_terms(one, raw, want):
    assert one(text.protect_symbol_terms, raw) == want


def test_numeric_terms(one):
    assert one(text.protect_numeric_terms, "985 211 4s 6s 3d") == "九八五 二一一 fourshop sixsigma threed"


@pytest.mark.parametrize("raw,want", [
    ("岗位职责：写代码。任职要求：1、本科；2、熟悉Java。薪资待遇：面议", "1、本科；2、熟悉Java。"),
    ("【岗位要求】 熟悉SQL 工作地点 北京", "熟悉SQL"),
    ("1、熟悉系统；2、掌握工具。福利：好", "1、熟悉系统；2、掌握工具。"),
    ("福利丰厚的公司。要求勤奋；有三年经验；会开车", "有三年经验"),
    ("太短", ""),
    ("没有任何信号的一段文字而已啊", ""),
])
def test_requirement_section(one, raw, want):
    assert one(text.requirement_section, raw) == want


def test_first_start_pattern_in_list_order_wins(one):
    # 任职要求 stands before 岗位要求 in the list, though later in the text
    assert one(text.requirement_section, "岗位要求：甲乙丙丁。任职要求：戊己庚辛") == "戊己庚辛"


def test_remove_noise(one):
    raw = "熟悉Java；五险一金，双休。 联系电话：12345\n周一至周五 13812345678 www.abc.com 详情"
    assert one(text.remove_noise, raw) == "熟悉Java"


def test_sentences(one):
    assert one(text.sentences, "本科学历，熟练使用CAD") == ["本科学历，熟练使用CAD"]
    long = "具备良好的沟通能力并且认真，熟练使用CAD与各种软件"
    assert one(text.sentences, long) == ["具备良好的沟通能力并且认真", "熟练使用CAD与各种软件"]
    assert one(text.sentences, "1、负责开发工作2、参与测试工作；短句。三、完成文档") == [
        "负责开发工作", "参与测试工作", "完成文档"]
    assert one(text.sentences, None) == []


@pytest.mark.parametrize("s,label", [
    ("本科学历，熟练使用CAD", "REMOVE:学历"), ("3 年以上Java", "REMOVE:经验年限"), ("18-35岁男女", "REMOVE:年龄外貌"),
    ("熟悉CAD制图", "KEEP"), ("持有导游证书", "KEEP"), ("吃苦耐劳的人", "REMOVE:软性人格"), ("天气很好啊", "DISCARD")])
def test_sentence_class(one, s, label):
    assert one(text.sentence_class, s) == label


def test_dictionary_hit_keeps_before_soft_trait(one):
    assert one(lambda c: text.sentence_class(c, c.contains("钢琴")), "热爱钢琴") == "KEEP"


def test_skill_text(spark):
    df = spark.createDataFrame([("熟悉Java开发；天气很好啊；吃苦耐劳者佳；负责系统维护",)], "d string")
    r = cleaning.with_skill_text(df, "d").first()
    assert r["skill_text"] == "熟悉Java开发；负责系统维护"
    assert (r["n_sentences_total"], r["n_sentences_kept"], r["has_skill_text"]) == (4, 2, 1)


def test_tokens(one):
    raw = "c r d java the 数据分析 的 人"
    assert one(text.latin_tokens, raw) == ["c", "r", "java", "数据分析"]


def test_segmentation_prefers_long_words():
    words = {"数据", "数据分析", "分析师"}
    assert segment.longest_match("数据分析师强", words, 4) == ["数据分析", "师", "强"]


def test_greedy_merge():
    assert segment.merge_pairs(list("abc"), {("a", "b"), ("b", "c")}) == ["a_b", "c"]
    assert segment.merge_pairs(list("aaaa"), {("a", "a")}) == ["a_a", "a_a"]


def test_distinct_pairs_stay_apart(spark):
    from jobpanel.operators import tokens

    rows = [["a", "b", "a", "b"], ["1:a", "b", "1:", "ab"], ["", "", "a", "", ""], ["数据", "分析", "数据"], ["a", None, "b", "c"], ["a"], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, t array<string>")
    got = {r["id"]: [tuple(p) for p in r["p"]] for r in df.select("id", tokens.distinct_pairs(tokens.neighbours(F.col("t"))).alias("p")).collect()}
    for i, r in enumerate(rows):
        assert got[i] == list(dict.fromkeys(p for p in zip(r, r[1:]) if None not in p))


def test_joined_runs_equal_the_rule_row_by_row():
    import pyarrow as pa

    rng = random.Random(3)
    phrases = {("a", "b"), ("b", "c"), ("c", "c"), ("a", "a"), ("\u0001", "b"), ("b_", "a")}
    words = ["a", "b", "c", "\u0001", "b_", "数据", ""]
    rows = [None, [], ["a"], ["a", "b"], ["b", "c"], ["a"] * 7, ["a", None, "b"], [None, None], ["c"] * 4001]
    rows += [[rng.choice(words) for _ in range(rng.randrange(40))] for _ in range(300)]
    held = [None if r is None else sorted({p for p in zip(r, r[1:]) if p in phrases}) or None for r in rows]
    kind = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))
    structs = [None if h is None else [{"a": a, "b": b} for a, b in h] for h in held]
    batch = pa.array(rows, pa.list_(pa.string())), pa.array(structs, kind)
    want = [None if r is None else segment.merge_pairs(r, phrases) for r in rows]
    assert segment.joined_runs(*batch).to_pylist() == want
    cut = [x.slice(3, 50) for x in batch]  # batches that begin inside their buffers
    assert segment.joined_runs(*cut).to_pylist() == want[3:53]
    assert segment.joined_runs(*[x.slice(0, 2) for x in batch]).to_pylist() == want[:2]
    assert segment.joined_runs(*[x.slice(0, 0) for x in batch]).to_pylist() == []


@pytest.mark.parametrize("raw,want", [
    ("Java工程师（急聘）", "Java工程师"), ("高薪诚聘会计5000元/", "会计"), ("销售+五险一金", "销售"),
    ("司机/包吃住", "司机"), ("·客服，", "客服")])
def test_clean_title(one, raw, want):
    assert one(titles.clean_title, raw) == want


def _canonical(name: str) -> str:
    """Plain loop form of the rule, for comparison."""
    s = name.strip().lower().replace("（", "(").replace("）", ")")
    s = re.sub(r"[\s·.,，。/\\|_\-;；:：!！?？\"'\[\]{}<>《》]+", "", s)
    s = s.replace("(中国)", "").replace("(china)", "").replace("()", "")
    region = "|".join(sorted(fixed.REGION_PREFIXES, key=len, reverse=True))
    tail = re.compile(f"(?:{region})[市省区县]?(?:{'|'.join(fixed.BRANCH_SUFFIXES)})$")
    again = True
    while again:
        before = s
        cut = tail.sub("", s)
        s = cut if len(cut) >= 2 else s
        for suffix in (*fixed.LEGAL_SUFFIXES, *fixed.BRANCH_SUFFIXES):
            if s.endswith(suffix) and len(s) - len(suffix) >= 2:
                s = s[:-len(suffix)]
        again = s != before
    again = True
    while again:
        before = s
        for p in fixed.REGION_PREFIXES:
            for hit in (p + "市", p + "省", p):
                if s.startswith(hit):
                    if len(s) - len(hit) >= 2:
                        s = s[len(hit):]
                    break
        again = s != before
    return re.sub("^[市省]+", "", s)


def test_canonical_company_matches_the_loop(spark):
    rng = random.Random(7)
    pieces = ["北京", "上海市", "广东省", "武汉", "甲", "乙丙", "丁戊己", "科技", "有限公司", "股份有限公司", "集团", "集团有限公司",
              "分公司", "武汉分公司", "办事处", "（中国）", "-", " ", "市"]
    names = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(600)})
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["c"] for r in df.withColumn("c", titles.canonical_company(F.col("n"))).collect()}
    wrong = {n: (got[n], _canonical(n)) for n in names if got[n] != _canonical(n)}
    assert not wrong


def test_split_titles(one):
    assert one(titles.split_titles, "Java工程师、测试工程师,java工程师（A、B）/会计") == [
        "Java工程师", "测试工程师", "java工程师（A、B）", "会计"]
    assert one(titles.split_titles, "UI/UX设计师|北京") == ["UI/UX设计师"]
    assert one(titles.split_titles, "") == []


def test_protected_titles(one):
    assert one(titles.split_titles_protected, "C/C++开发/UI/UX设计") == ["C/C++开发", "UI/UX设计"]
    assert one(titles.split_titles_protected, "会计") == []


def test_single_title(one):
    assert one(lambda c: titles.single_title(titles.title_parts(c)), "高级/人力行政主管") == "高级人力行政主管"
    assert one(lambda c: titles.single_title(titles.title_parts(c)), "会计/北京") == "会计"
    assert one(lambda c: titles.single_title(titles.title_parts(c)), "会计") is None


def test_titles_from_description(one):
    two = "职位描述\n1、Java工程师\n2、测试工程师\n要求负责"
    assert one(titles.titles_from_description, two) == ["Java工程师", "测试工程师"]
    assert one(titles.titles_from_description, "职位描述\n会计") == ["会计"]
    assert one(titles.titles_from_description, "岗位名称：销售经理\n其他") == ["销售经理"]
    assert one(titles.strict_titles_from_description, two) == ["Java工程师", "测试工程师"]


def test_fields_from_description(one):
    d = "公司名称：宏图科技有限公司\n工作地点：上海市浦东新区1号"
    assert one(titles.extract_company, d) == "宏图科技有限公司"
    assert one(titles.extract_location, d) == "上海市浦东新区1号"
    assert one(lambda c: titles.extract_city(F.lit(""), c), d) == "上海"
    assert one(lambda c: titles.extract_region(F.lit(""), c, F.lit("上海")), d) == "市浦东新区"


@pytest.mark.parametrize("raw,want", [
    ("不限", None), ("", None), ("应届毕业生", 0.0), ("3-5年", 4.0), ("5年以上", 5.0), ("1年以下", 0.5), ("2年", 2.0),
    ("若干", None)])
def test_experience(one, raw, want):
    assert one(text.experience_years, raw) == want


def test_education(one):
    assert one(text.education_code, " 本科及以上 ") == 4
    assert one(text.education_code, "小学") is None


def test_proficiency(spark):
    df = spark.createDataFrame([("精通Java，熟练掌握SQL，了解Linux",), ("无",)], "d string")
    rows = df.select(*[c.alias(n) for n, c in text.proficiency_columns(F.col("d")).items()]).collect()
    assert rows[0]["proficiency_mean"] == pytest.approx(6.5 / 3)
    assert (rows[0]["proficiency_max"], rows[0]["proficiency_count"]) == (3.0, 3)
    assert rows[0]["high_ratio"] == pytest.approx(2 / 3)
    assert rows[1]["proficiency_mean"] is None and rows[1]["proficiency_count"] == 0


@pytest.mark.parametrize("city,want", [
    ("北京", True), ("阳谷县", True), ("纽约", False), ("Tokyo Japan", False), ("印度尼西亚", False), ("Springfield", False),
    ("", False), (None, False), ("测试城", True)])
def test_domestic_city(one, city, want):
    assert one(lambda c: quality.is_domestic_city(c, ("测试城",)), city) is want


def _posting(**kw):
    row = dict(row_id=1, company="甲公司", title="会计", city="北京", salary_min="5000", salary_max="8000",
               education="本科", experience="2年", category="全职", primary_category="", description="这是一个足够长的职位描述文本",
               publish_date="2020-01-01", publish_year="2020.0")
    return {**row, **kw}


@pytest.mark.parametrize("change,reason", [
    ({}, []), ({"company": " "}, ["missing_company"]), ({"title": None}, ["missing_title"]), ({"city": "　"}, ["missing_city"]),
    ({"salary_min": "100"}, ["min_salary_low"]), ({"salary_min": "2000000", "salary_max": "0"}, ["min_salary_high"]),
    ({"salary_max": "100"}, ["max_salary_low", "salary_order"]), ({"salary_min": "9000"}, ["salary_order"]),
    ({"salary_min": "面议", "salary_max": "100"}, []), ({"description": None}, ["missing_description"]),
    ({"description": "短"}, ["short_description"]), ({"publish_year": "2009"}, ["year_early"]),
    ({"publish_year": "2027.0"}, ["year_late"]), ({"publish_year": "去年"}, []), ({"publish_year": "2010"}, []),
    ({"publish_year": "2026"}, [])])
def test_fake_reasons(spark, change, reason):
    df = spark.createDataFrame([_posting(**change)], ", ".join(
        f"{k} {'long' if k == 'row_id' else 'string'}" for k in _posting()))
    assert df.select(quality.fake_reasons()).first()[0] == reason


def test_rule_chain_counts_copies_among_survivors_only(spark):
    same = "相同的描述" * 25
    rows = [_posting(row_id=1, company=""), _posting(row_id=2), _posting(row_id=3), _posting(row_id=4, city="香港"),
            _posting(row_id=5, description=same + "甲"), _posting(row_id=6, description=same + "乙")]
    df = spark.createDataFrame(rows, ", ".join(
        f"{k} {'long' if k == 'row_id' else 'string'}" for k in _posting()))
    got = {r["row_id"]: r["reject_reason"] for r in cleaning.with_reject_reason(df).collect()}
    # rows 5 and 6 differ only after the hundredth character
    assert got == {1: "fake", 2: "valid", 3: "duplicate", 4: "irrelevant", 5: "valid", 6: "duplicate"}


def test_ladder_reads_it_as_a_word(one):
    from jobpanel.operators.lookup import ladder_industry

    assert one(ladder_industry, "IT/软件") == "I"
    assert one(ladder_industry, "IT") == "I"
    assert one(ladder_industry, "Fitness") == "U"
    assert one(ladder_industry, "家庭服务") == "O"


def test_urls(one):
    assert one(urls.url_host, "http://WWW.A.com/x?y") == "www.a.com"
    assert one(urls.url_path, "http://a.com") == ""
    assert one(urls.is_high_value, "http://a.com/") is False
    assert one(urls.is_high_value, "http://a.com/jobs/1") is True
    assert one(urls.is_high_value, "http://u@a.com/jobs/1") is False
    assert one(urls.capture_date, "20190230") == ""
    assert one(urls.capture_date, "20190228010203") == "2019-02-28"


def test_skill_score_rounds_half_to_even_and_lowers_both_sides(one):
    levels = {1: ["会使用"], 3: ["精通"]}
    assert one(lambda d, e: skills.skill_score(d, e, ["Excel"], levels), "精通excel", "硕士") == 4
    assert one(lambda d, e: skills.skill_score(d, e, ["Excel"], levels), "EXCEL", "不限") == 2
    assert one(lambda d, e: skills.skill_score(d, e, ["Excel"], levels), "会使用excel", "高中") == 1
    assert one(lambda d, e: skills.skill_score(d, e, ["Excel"], levels), "写作", "博士") == 0


def test_rule_order(one):
    rules = [("数据分析", "a"), ("分析", "b")]
    assert one(lambda t: skills.first_rule(t, rules), "数据分析师") == "a"
    assert one(lambda t: skills.first_rule(t, rules), "分析师") == "b"
    assert one(lambda t: skills.first_rule(t, rules), "会计") is None


def test_payload_items(one):
    from jobpanel.operators import enrich

    raw = '```json\n[{"company_name": "甲", "title": "会计"}, {"招聘岗位": "会计", "企业名称": "甲"}, {"city": ""}]\n```'
    items = one(enrich.parse_items, raw)
    assert [(i["company"], i["title"]) for i in items] == [("甲", "会计")]
    assert one(enrich.parse_items, "error") == []


def test_complete_items(spark):
    from jobpanel.operators import enrich

    df = spark.createDataFrame([('[{"city": "北京"}]',), ('[{"title": "会计、出纳员", "city": "上海"}]',), ("[]",)], "p string")
    guess = F.array(F.lit("Java工程师"), F.lit("测试工程师"))
    rows = df.select(enrich.complete_items(enrich.parse_items(F.col("p")), guess).alias("x")).collect()
    got = [[(i["title"], i["city"]) for i in r["x"]] for r in rows]
    assert got == [[("Java工程师", "北京"), ("测试工程师", "北京")], [("会计", "上海"), ("出纳员", "上海")],
                   [("Java工程师", ""), ("测试工程师", "")]]


def test_literals_of_noise_patterns_hold_for_every_match():
    assert text._needles(r"(?:免费)?(?:工作餐|午餐)[^。]*") == ["工作餐", "午餐"]
    assert text._needles(r"[【\[]?\s*要求\s*[:：]") == ["要求"]
    assert text._needles(r"甲|乙") == [] and text._needles(r"\d+") == []


def test_costly_parts_of_title_expressions_are_evaluated_once():
    def parts(c):
        return F.split(c, "MARK")

    for f in (titles.unique_ignoring_case, titles.single_title):
        assert str(f(parts(F.col("c")))).count("MARK") == 1
    assert str(titles.split_outside_brackets(F.concat(F.col("c"), F.lit("MARK")))).count("MARK") == 1
    assert str(text._unless_empty(F.concat(F.col("c"), F.lit("MARK")))).count("MARK") == 1
