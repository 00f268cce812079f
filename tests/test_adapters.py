"""Views of the driver's tables."""
import datetime

from shopaudit.operators import monitor
from shopaudit.sources import adapters


def test_members_join_a_minute_apart_and_the_first_owner_counts(spark, tmp_path):
    # By minutes the member of day 0 joins on day 2, after the one of day 1.
    rows = [(2920, 1, "HOUSEHOLD"), (313, 1, "HOUSEHOLD"), (1, 1, "BUILDING")]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    members = adapters.memberships(spark, str(tmp_path))
    joined = {r["email"]: r["t"] for r in members.selectExpr("email", "cast(created_at AS string) t").collect()}
    assert joined == {f"user{k}@mail.example": str(datetime.datetime(1993, 1, 1) + datetime.timedelta(days=k * 7 % 365, minutes=k)) for k, _, _ in rows}
    assert monitor.owner_emails(members).first()["email"] == "user313@mail.example"
