"""Canonical tables. Ids are text: user ids are names or digits."""

from pyspark.sql import types as T


def _table(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


GROUPS = _table("group_id string, user_id string, pubdate timestamp, description string, topic_ids array<string>")
THREADS = _table("topic_id string, group_id string, user_id string, pubdate timestamp, title string, content string, comment_ids array<string>")
DATASET = _table("topic_id string, group_id string, user_id string, pubdate timestamp, title string, content string, comment_ids array<string>, commenters array<string>, split string")
COMMENTS = _table("comment_id string, group_id string, topic_id string, user_id string, pubdate timestamp, ref_comment_id string, content string")
EDGES = _table("src string, dst string")
BEHAVIOUR = _table("user_id string, num_comments bigint, num_topics bigint")
INTEREST = _table("user_id string, interest array<double>")
MUTUAL = _table("a string, b string, n bigint")
PAGES = _table("page_id bigint, url string, html string")
PREDICTIONS = _table("topic_id string, user_id string, label int, prob double")
