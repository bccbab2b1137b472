"""Struct types shared by the operators."""

from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
])
SPANS = T.ArrayType(SPAN)

SENTIMENT = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
])

EMOTION = T.StructType([
    T.StructField("emotion", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
])

KEYPHRASES = T.StructType([
    T.StructField("keyphrases", T.ArrayType(T.StringType())),
    T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
])

SECTION = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("key_points", T.ArrayType(T.StringType())),
    T.StructField("data_sources", T.ArrayType(T.StringType())),
    T.StructField("estimated_length", T.StringType()),
])

OUTLINE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("sections", T.ArrayType(SECTION)),
    T.StructField("recommended_length", T.StringType()),
    T.StructField("key_insights", T.ArrayType(T.StringType())),
    T.StructField("recommended_focus", T.ArrayType(T.StringType())),
    T.StructField("narrative_flow", T.ArrayType(T.StringType())),
])

CRITERION = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("issues", T.ArrayType(T.StringType())),
    T.StructField("critical", T.BooleanType()),
])

EVALUATION = T.StructType([
    T.StructField("overall_score", T.DoubleType()),
    T.StructField("should_regenerate", T.BooleanType()),
    T.StructField("checks", T.MapType(T.StringType(), CRITERION)),
    T.StructField("issues", T.ArrayType(T.StringType())),
    T.StructField("feedback", T.StringType()),
])

DECISION = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("reasoning", T.StringType()),
])
