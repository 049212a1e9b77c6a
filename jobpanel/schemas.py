"""Declared schemas and rename maps."""

from pyspark.sql import types as T

POSTING = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("company", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("salary_min", T.StringType()),
    T.StructField("salary_max", T.StringType()),
    T.StructField("education", T.StringType()),
    T.StructField("experience", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("primary_category", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("publish_date", T.StringType()),
    T.StructField("publish_year", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("origin", T.StringType()),
])

# Source column names.
POSTING_RENAMES = {
    "企业名称": "company", "招聘岗位": "title", "工作城市": "city", "工作区域": "district",
    "工作地点": "location", "最低月薪": "salary_min", "最高月薪": "salary_max",
    "学历要求": "education", "要求经验": "experience", "招聘类别": "category",
    "初级分类": "primary_category", "职位描述": "description", "招聘发布日期": "publish_date",
    "招聘发布年份": "publish_year", "来源平台": "platform", "数据平台": "platform", "来源": "origin",
}
DROPPED_COLUMNS = ("关联股票代码", "与上市公司关系")
DATA_SOURCES = ("上市公司", "应届生", "综合")

TOKENS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("year", T.StringType()),
    T.StructField("tokens", T.ArrayType(T.StringType())),
    T.StructField("is_fresh_grad", T.IntegerType()),
    T.StructField("platform", T.StringType()),
    T.StructField("data_source", T.StringType()),
    T.StructField("token_count", T.IntegerType()),
])
