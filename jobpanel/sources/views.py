"""Views that give the driver's tables the shape of postings, panels and topics.

Every view exists twice: as a DataFrame and as SQL text for the checks. The
posting view is one SQL text that both engines read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import fixed, text, vec
from ..session import shared_folder, spread

K_THETA, K_TOPICS, MIN_DF = 64, 8, 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the folder all executors share."""
    return f"{shared_folder(spark)}/jobpanel-{uuid.uuid4().hex}"


# --- text ---------------------------------------------------------------------------

def docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents")).select(
        F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("platform"),
        (2016 + F.col("doc_id") % 10).cast("int").alias("year"), "n_chars")


DOCS = """docs AS (
  SELECT doc_id AS id, text, lang, source AS platform,
         CAST(2016 + doc_id % 10 AS INTEGER) AS "year", n_chars
  FROM documents)"""


def token_docs(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.tokens import token_documents

    return token_documents(docs(spark, folder), "text")


def sql_list(words) -> str:
    return ", ".join("'" + str(w).replace("'", "''") + "'" for w in words)


TOKENS = DOCS + f""",
toks AS (
  SELECT * FROM (
    SELECT id, lang, platform, "year", n_chars,
           list_filter(regexp_extract_all(lower(text), '[a-z]+|[一-龥]+'), lambda t:
             CASE WHEN regexp_matches(t, '^[a-z]+$')
                  THEN CASE WHEN length(t) = 1 THEN t IN ({sql_list(fixed.SINGLE_LETTERS)})
                            ELSE t NOT IN ({sql_list(fixed.LATIN_BLACKLIST)}) END
                  ELSE length(t) >= 2 AND t NOT IN ({sql_list(fixed.HAN_STOPWORDS)}) END) AS tokens
    FROM docs)
  WHERE len(tokens) >= 5)"""

TERMS = TOKENS + """,
terms AS (SELECT term, count(*) AS cf FROM (SELECT unnest(tokens) AS term FROM toks) GROUP BY term),
doc_terms AS (
  SELECT id, term, count(*) AS n FROM (SELECT id, unnest(tokens) AS term FROM toks) GROUP BY id, term),
pairs AS (
  SELECT a, b, count(*) AS n
  FROM (SELECT unnest(tokens[1:len(tokens) - 1]) AS a, unnest(tokens[2:len(tokens)]) AS b FROM toks)
  GROUP BY a, b)"""


def topic_words(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """(term, rank, p) for the whole vocabulary; shares from integer arithmetic."""
    from ..operators.tokens import vocabulary

    rows = token_docs(spark, folder) if rows is None else rows
    whole = Window.partitionBy()  # the vocabulary, which its selection bounds
    ranked = vocabulary(rows, "id", min_df=MIN_DF).withColumn(
        "rank", F.row_number().over(whole.orderBy(F.desc("df"), "term")))
    raw = [(1 + (F.col("rank") * (k + 3)) % 17).cast("double") for k in range(K_TOPICS)]
    return ranked.select(
        "term", "rank", F.array(*[r / F.sum(r).over(whole) for r in raw]).alias("p"))


VOCABULARY = TERMS + f""",
vocab AS (
  SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM doc_terms GROUP BY term
  HAVING count(*) >= {MIN_DF} AND count(*) <= {fixed.VOCAB_MAX_DF} * (SELECT count(*) FROM toks)
  ORDER BY df DESC, term LIMIT {fixed.VOCAB_KEEP})"""

TOPIC_WORDS = VOCABULARY + f""",
ranked AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) AS rank FROM vocab),
topic_word AS (
  SELECT term, rank, k, w / sum(w) OVER (PARTITION BY k) AS p
  FROM (SELECT term, rank, k, CAST(1 + (rank * (k + 3)) % 17 AS DOUBLE) AS w
        FROM ranked, range({K_TOPICS}) r(k)))"""

# --- vectors -------------------------------------------------------------------------


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def theta(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).select(
        "id", "label", (F.col("label") % 5).alias("win"), vec.softmax(F.col("v")).alias("theta"))


THETA = """powers AS (
  SELECT vec_id AS id, label, label % 5 AS win,
         list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e
  FROM embeddings),
theta AS (
  SELECT id, label, win, list_transform(e, lambda x: x / list_sum(e)) AS theta FROM powers),
long AS (
  SELECT id, label, win, unnest(theta) AS p, unnest(range(len(theta))) AS k FROM theta)"""


def topic_centroids(spark: SparkSession, folder: str, per_window: int = 12) -> DataFrame:
    """Topic vectors: mean vectors of twelve groups in each of five windows."""
    rows = vectors(spark, folder).select(
        (F.col("label") % 5).alias("win"), (F.col("id") % per_window).cast("int").alias("topic"), "v")
    return rows.groupBy("win", "topic").agg(vec.mean_vector(F.col("v"), K_THETA).alias("v"))


CENTROIDS = """long_v AS (
  SELECT label % 5 AS win, CAST(vec_id % 12 AS INTEGER) AS topic,
         CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
cells AS (SELECT win, topic, i, avg(x) AS x FROM long_v GROUP BY win, topic, i),
sizes AS (SELECT win, topic, sqrt(sum(x * x)) AS size FROM cells GROUP BY win, topic),
cosines AS (
  SELECT a.win AS window_from, b.win AS window_to, a.topic AS source, b.topic AS target,
         sum(a.x * b.x) / (any_value(sa.size) * any_value(sb.size)) AS sim
  FROM cells a JOIN cells b ON b.win = a.win + 1 AND a.i = b.i
  JOIN sizes sa ON sa.win = a.win AND sa.topic = a.topic
  JOIN sizes sb ON sb.win = b.win AND sb.topic = b.topic
  GROUP BY a.win, b.win, a.topic, b.topic)"""

# --- panel ---------------------------------------------------------------------------


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as postings: occupation, industry, year and metrics."""
    line, part = spread(table(spark, folder, "lineitem")), table(spark, folder, "part")
    order, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    return (
        line.join(order, line.l_orderkey == order.o_orderkey)
        .join(part, line.l_partkey == part.p_partkey)
        .join(customer, order.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.year("l_shipdate").alias("year"), F.col("p_brand").alias("occ"),
            F.col("c_mktsegment").alias("ind"), F.col("n_name").alias("nation"),
            F.col("p_name").alias("title"), F.col("c_name").alias("company"), F.col("p_type").alias("kind"),
            F.col("l_discount").alias("ent"), F.col("l_quantity").alias("eff"), F.col("l_tax").alias("tax"),
            F.col("l_extendedprice").alias("salary"), F.col("p_size").alias("size"),
            F.col("l_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"),
            F.col("l_returnflag").alias("flag"), (F.col("l_partkey") % 8).alias("topic")))


PANEL = """panel AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS "year", p_brand AS occ, c_mktsegment AS ind, n_name AS nation,
         p_name AS title, c_name AS company, p_type AS kind, l_discount AS ent, l_quantity AS eff,
         l_tax AS tax, l_extendedprice AS salary, p_size AS size, l_orderkey AS order_id,
         o_orderstatus AS status, l_returnflag AS flag, l_partkey % 8 AS topic
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def exposure(spark: SparkSession, folder: str) -> DataFrame:
    """Exposure score per occupation."""
    return table(spark, folder, "part").groupBy(F.col("p_brand").alias("occ")).agg(
        (F.avg("p_size") / 50).alias("exposure"))


EXPOSURE = "exposure AS (SELECT p_brand AS occ, avg(p_size) / 50 AS exposure FROM part GROUP BY p_brand)"


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Occupation x industry x year cells with exposure and treatment columns."""
    from ..operators.econ import did_columns

    base = panel(spark, folder).groupBy("occ", "ind", "year").agg(
        F.count(F.lit(1)).alias("n_jobs"), F.avg("ent").alias("ent"), F.avg("eff").alias("eff"),
        F.avg("salary").alias("salary"), F.stddev_pop("ent").alias("sd_ent"))
    return did_columns(base.join(exposure(spark, folder), "occ"), 1999)


CELLS = PANEL + ", " + EXPOSURE + """,
cells AS (
  SELECT c.*, e.exposure, CASE WHEN "year" >= 1999 THEN 1 ELSE 0 END AS post,
         e.exposure * CASE WHEN "year" >= 1999 THEN 1 ELSE 0 END AS treat_x_post
  FROM (SELECT occ, ind, "year", count(*) AS n_jobs, avg(ent) AS ent, avg(eff) AS eff,
               avg(salary) AS salary, stddev_pop(ent) AS sd_ent
        FROM panel GROUP BY occ, ind, "year") c
  JOIN exposure e ON e.occ = c.occ)"""

# --- postings ------------------------------------------------------------------------

POSTINGS_SQL = """
SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 53 = 0 THEN NULL ELSE
    CASE c_nationkey % 6 WHEN 0 THEN '北京' WHEN 1 THEN '上海市' WHEN 2 THEN '深圳' WHEN 3 THEN '广东省' ELSE '' END
    || CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '华通汽车制造' WHEN 'BUILDING' THEN '宏图建筑'
       WHEN 'FURNITURE' THEN '雅居家具' WHEN 'HOUSEHOLD' THEN '安心家政服务' ELSE '恒力机械' END
    || cast(c_custkey % 40 as string)
    || CASE c_custkey % 5 WHEN 0 THEN '有限公司' WHEN 1 THEN '股份有限公司' WHEN 2 THEN '集团有限公司武汉分公司'
       WHEN 3 THEN '（中国）有限公司' ELSE '工作室' END END AS company,
  CASE o_orderkey % 16 WHEN 0 THEN 'Java开发工程师（急聘）' WHEN 1 THEN '数据分析师、数据挖掘工程师'
    WHEN 2 THEN '销售经理+五险一金' WHEN 3 THEN '会计' WHEN 4 THEN 'C/C++开发工程师' WHEN 5 THEN '普工5000元/月'
    WHEN 6 THEN '行政助理/前台文员' WHEN 7 THEN '高级/人力行政主管' WHEN 8 THEN '英语翻译' WHEN 9 THEN '销售实习生'
    WHEN 10 THEN '客户经理' WHEN 11 THEN '急聘算法工程师' WHEN 12 THEN '' WHEN 13 THEN 'AI产品经理'
    WHEN 14 THEN '高薪诚聘UI/UX设计师,包吃住' ELSE '叉车工' END AS title,
  CASE o_orderkey % 11 WHEN 0 THEN '北京' WHEN 1 THEN '上海市' WHEN 2 THEN '香港' WHEN 3 THEN '纽约'
    WHEN 4 THEN '阳谷县' WHEN 5 THEN '深圳' WHEN 6 THEN 'Tokyo Japan' WHEN 7 THEN ' 武汉 ' WHEN 8 THEN '广东省'
    WHEN 9 THEN '杭州市西湖区' ELSE CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '成都市' END END AS city,
  '' AS district, '' AS location,
  CASE WHEN o_orderkey % 31 = 0 THEN '面议' WHEN o_orderkey % 37 = 0 THEN NULL
    ELSE cast(cast(floor(o_totalprice / 20) as bigint) as string) END AS salary_min,
  CASE WHEN o_orderkey % 29 = 0 THEN '100' WHEN o_orderkey % 43 = 0 THEN '2000000'
    ELSE cast(cast(floor(o_totalprice / 15) as bigint) as string) END AS salary_max,
  CASE o_orderkey % 8 WHEN 0 THEN '本科' WHEN 1 THEN '大专以上' WHEN 2 THEN '硕士' WHEN 3 THEN '不限' WHEN 4 THEN '高中'
    WHEN 5 THEN 'MBA' WHEN 6 THEN ' 本科及以上 ' ELSE '博士' END AS education,
  CASE o_orderkey % 9 WHEN 0 THEN '不限' WHEN 1 THEN '3-5年' WHEN 2 THEN '1年以下' WHEN 3 THEN '5年以上'
    WHEN 4 THEN '应届毕业生' WHEN 5 THEN '2年' WHEN 6 THEN '无经验' WHEN 7 THEN '10年以上' ELSE '若干' END AS experience,
  CASE o_orderkey % 10 WHEN 0 THEN '兼职' WHEN 1 THEN '校园招聘' WHEN 2 THEN '互联网/IT<软件开发'
    WHEN 3 THEN '管理培训生' WHEN 4 THEN '生产制造' ELSE '全职' END AS category,
  CASE o_orderkey % 6 WHEN 0 THEN '计算机软件' WHEN 1 THEN 'IT服务' WHEN 2 THEN 'nan' WHEN 3 THEN '银行/保险'
    ELSE '' END AS primary_category,
  CASE WHEN o_orderkey % 47 = 0 THEN NULL WHEN o_orderkey % 47 = 1 THEN '短描述' ELSE
    CASE o_orderkey % 9 WHEN 0 THEN '公司名称：' || '宏图科技有限公司' || chr(10) || '工作地点：上海市浦东新区张江路1号' || chr(10)
      WHEN 1 THEN '职位描述' || chr(10) || '1、Java工程师' || chr(10) || '2、测试工程师' || chr(10) ELSE '' END
    || CASE o_orderkey % 4 WHEN 0 THEN '岗位职责：1、负责系统开发与测试；2、参与需求分析和架构设计。'
       WHEN 1 THEN '1、熟悉数据分析，掌握Excel报表，能够独立完成业务汇总；2、沟通能力强。'
       WHEN 2 THEN '我们提供良好平台。' ELSE '工作内容：客户沟通、项目协调、培训指导。' END
    || CASE o_orderkey % 3 WHEN 0 THEN '任职要求：' WHEN 1 THEN '【岗位要求】' ELSE '' END
    || CASE o_orderkey % 5 WHEN 0 THEN '1、本科及以上学历；2、熟练使用Python与SQL，3年以上工作经验，能做数据录入；'
       WHEN 1 THEN '精通Java与C++，熟悉Node.js，了解.NET；吃苦耐劳；' WHEN 2 THEN '持有会计证书；熟练掌握Office；'
       WHEN 3 THEN '985/211院校优先，熟悉3D建模；' ELSE '性格开朗，有责任心；年龄18-35岁；' END
    || CASE o_orderkey % 7 WHEN 0 THEN '薪资待遇：五险一金，周末双休。' WHEN 1 THEN '包吃包住，年终奖丰厚。' ELSE '' END
    || CASE o_orderkey % 13 WHEN 0 THEN '微商代理，日赚500，加微信。' ELSE '' END
    || CASE WHEN o_orderkey % 3 = 0 THEN '编号' || cast(o_custkey as string) ELSE '' END END AS description,
  cast(cast(o_orderdate as date) as string) AS publish_date,
  CASE o_orderkey % 59 WHEN 0 THEN '' WHEN 1 THEN '2009' WHEN 2 THEN '2027.0'
    ELSE cast(year(o_orderdate) + 21 as string) || '.0' END AS publish_year,
  CASE o_orderkey % 7 WHEN 0 THEN 'zhaopin' WHEN 1 THEN '51job' WHEN 2 THEN '' WHEN 3 THEN 'liepin' ELSE 'other' END AS platform,
  CASE o_orderkey % 3 WHEN 0 THEN '综合' WHEN 1 THEN '应届生' ELSE '上市公司' END AS data_source
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""


def postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        POSTINGS_SQL, orders=spread(table(spark, folder, "orders"), 4), customer=table(spark, folder, "customer"))


POSTINGS = "postings AS (" + POSTINGS_SQL.format(orders="orders", customer="customer") + ")"

# --- web captures ---------------------------------------------------------------------

CAPTURES_SQL = """
SELECT page_id AS idx,
  CASE page_id % 9 WHEN 0 THEN '2018' WHEN 1 THEN '2020' ELSE '2019' END
    || CASE page_id % 3 WHEN 0 THEN '0115' WHEN 1 THEN '0230' ELSE '1107' END || '083000' AS ts,
  CASE page_id % 8 WHEN 0 THEN replace(url, '/fr/', '/job/') WHEN 1 THEN url || '&jobid=7'
    WHEN 2 THEN 'http://www.zhaopin.com/index.html' WHEN 3 THEN replace(url, 'example.com/', 'example.com/position/')
    WHEN 4 THEN 'http://user@jobs.51job.com/x' WHEN 5 THEN replace(url, 'example.com/', 'example.com/search/job/')
    WHEN 6 THEN 'http://10.0.0.7/jobs/12' ELSE url END AS original,
  md5(html) AS digest, html,
  CASE page_id % 4 WHEN 0 THEN 'zhaopin' WHEN 1 THEN '' WHEN 2 THEN '51job' ELSE 'other' END AS platform,
  CASE page_id % 5 WHEN 0 THEN 'www.zhaopin.com' WHEN 1 THEN 'jobs.51job.com' WHEN 2 THEN '10.0.0.7'
    WHEN 3 THEN 'sub.liepin.com' ELSE 'blog.example.com' END AS domain
FROM {pages}
"""


def captures(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(CAPTURES_SQL, pages=spread(table(spark, folder, "pages")))


CAPTURES = "captures AS (" + CAPTURES_SQL.format(pages="pages") + ")"

# --- lookups --------------------------------------------------------------------------

MATCHES_SQL = """
SELECT p_partkey AS part_id,
  CASE p_partkey % 3 WHEN 0 THEN p_name || '（急聘）' ELSE p_name END AS title,
  '2' || lpad(replace(p_brand, 'Brand#', ''), 3, '0') AS isco08_4digit,
  CASE WHEN p_partkey % 7 = 0 THEN 'False' ELSE 'True' END AS sbert_accepted
FROM {part}
"""


def title_matches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(MATCHES_SQL, part=table(spark, folder, "part"))


MATCHES = "matches AS (" + MATCHES_SQL.format(part="part") + ")"


def code_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score table per occupation code; one code in five has none."""
    code = F.concat(F.lit("2"), F.lpad(F.replace("p_brand", F.lit("Brand#"), F.lit("")), 3, "0"))
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return (
        table(spark, folder, "part").withColumn("isco08_4digit", code).filter(number % 5 != 0)
        .groupBy("isco08_4digit").agg((F.avg("p_size") / 50).alias("mean_score"), F.lit(0.1).alias("sd_score"))
        .withColumn("exposure_gradient", F.when(F.col("mean_score") > 0.52, "Gradient 4")
                    .when(F.col("mean_score") > 0.5, "Gradient 2").otherwise("Not Exposed")))


SCORES = """scores AS (
  SELECT *, CASE WHEN mean_score > 0.52 THEN 'Gradient 4' WHEN mean_score > 0.5 THEN 'Gradient 2'
            ELSE 'Not Exposed' END AS exposure_gradient
  FROM (SELECT '2' || lpad(replace(p_brand, 'Brand#', ''), 3, '0') AS isco08_4digit,
               avg(p_size) / 50 AS mean_score, 0.1 AS sd_score
        FROM part WHERE CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 5 <> 0 GROUP BY 1))"""
