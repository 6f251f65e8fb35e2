"""Schemas of requests and responses. Meta values are JSON text."""

from pyspark.sql import types as T

HEADERS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
META = T.MapType(T.StringType(), T.StringType())
HTTP = T.StructType([T.StructField("query", META), T.StructField("cookies", META), T.StructField("allow_redirects", T.BooleanType())])
BROWSER = T.StructType([T.StructField(n, t) for n, t in (("driver", T.StringType()), ("engine", T.StringType()), ("headless", T.BooleanType()), ("stealth", T.BooleanType()), ("fingerprint_profile", T.StringType()), ("wait_for", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()))])
REQUEST = T.StructType([T.StructField(n, t) for n, t in (("url", T.StringType()), ("mode", T.StringType()), ("method", T.StringType()), ("headers", HEADERS), ("body", T.BinaryType()), ("meta", META), ("callback", T.StringType()), ("dont_filter", T.BooleanType()), ("http", HTTP), ("browser", BROWSER))])
FRONTIER = T.StructType([T.StructField("seq", T.LongType()), *REQUEST.fields, T.StructField("ready_at_ms", T.LongType()), T.StructField("priority", T.IntegerType()), T.StructField("nacks", T.IntegerType())])
RESPONSE = T.StructType([T.StructField(n, t) for n, t in (("url", T.StringType()), ("status", T.IntegerType()), ("headers", HEADERS), ("body", T.BinaryType()), ("text", T.StringType()), ("flags", T.ArrayType(T.StringType())), ("ip_address", T.StringType()), ("protocol", T.StringType()))])
ERROR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("message", T.StringType())])
