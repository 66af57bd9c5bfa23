"""Connected components of a link table, as joins: no links or components leave the cluster."""

from pyspark.sql import functions as F

from quillgate.llm.store import saved, sent


def components(links):
    """(node, component) for every end of (a, b) links; the component is its smallest node.

    Every round takes the smallest component among the neighbours and then follows the component's own
    component, so paths halve; rounds go on until nothing changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = saved(both, "edges")
    now = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("component")), "components")
    while True:
        heard = both.join(sent(now.select(F.col("node").alias("b"), "component")), "b").select(F.col("a").alias("node"), "component")
        own = now.select("node", "component", F.col("component").alias("before"))
        step = heard.unionByName(own, allowMissingColumns=True).groupBy("node").agg(
            F.min("component").alias("component"), F.min("before").alias("before"))
        step = saved(step, "step")
        up = step.select(F.col("node").alias("component"), F.col("component").alias("top"))
        now = saved(step.join(sent(up), "component").select("node", "before", F.col("top").alias("component")), "components")
        if now.where("component <> before").isEmpty():
            return now.select("node", "component")
