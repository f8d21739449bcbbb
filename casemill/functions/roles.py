"""Semantic roles: what a column means, and which column of a table has a role."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The roles and the ordered name patterns that assign them; the first match wins.
ROLES = (
    "id", "timestamp", "date", "latitude", "longitude", "admin_area_1", "admin_area_2", "admin_area_3", "category", "subcategory", "status", "person_name",
    "phone", "address", "identifier", "age", "gender", "measure", "money", "free_text", "boolean", "foreign_key", "other",
)
NAME_PATTERNS = (
    ("latitude", r"lat(itude)?$"),
    ("longitude", r"^(lng|lon|long|longitude)$|longitude"),
    ("timestamp", r"(^|_)(ts|timestamp|datetime|date_time|occurred|reported)(_|$)|_at$"),
    ("date", r"(^|_)date($|_)|_on$|dob|year_month"),
    ("admin_area_1", r"district"),
    ("admin_area_2", r"(police_)?station|taluk|tehsil|circle|sub_division"),
    ("admin_area_3", r"beat|locality|ward|village|area_name"),
    ("phone", r"phone|mobile|contact_no|msisdn"),
    ("address", r"address|residence"),
    ("identifier", r"upi|vpa|imei|aadhaa?r|passport|pan_no|acc(oun)?t_no|vehicle_(no|reg)|email"),
    ("measure", r"population|density|household|literacy|urbani[sz]|_km2$|sq_km"),
    ("age", r"(^|_)age($|_)"),
    ("gender", r"gender|sex"),
    ("person_name", r"(^|_)name($|_)"),
    ("money", r"amount|value|price|cost|loss|salary|income"),
    ("status", r"status|disposal|stage"),
    ("category", r"category|group|head|type|class(ification)?|crime|offence|modus|mo($|_)"),
    ("free_text", r"description|details|summary|narrative|remarks|text"),
    ("id", r"(^|_)(id|no|num|number|code)$|^fir"),
)


@dataclass
class RoleMap:
    """Columns by role, in the order of the table; ``first`` is the column an operator uses."""

    columns: dict[str, str] = field(default_factory=dict)

    def all(self, *roles: str) -> list[str]:
        return [c for r in roles for c, own in self.columns.items() if own == r]

    def first(self, *roles: str) -> str | None:
        return next(iter(self.all(*roles)), None)

    @property
    def time(self) -> str | None:
        return self.first("timestamp", "date")

    @property
    def area(self) -> str | None:
        return self.first("admin_area_1")


def unavailable(spark: SparkSession, schema: str, reason: str) -> DataFrame:
    """An empty result that says why in its ``unavailable`` attribute."""
    out = spark.createDataFrame([], schema)
    out.unavailable = reason
    return out
