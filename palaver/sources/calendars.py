"""Calendar events as they come from calendar services, flattened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "subject string, organizer struct<emailAddress:struct<name:string,address:string>>, attendees array<struct<emailAddress:struct<name:string,address:string>>>, recurrence struct<pattern:string>, location struct<displayName:string>, bodyPreview string"
OTHER_EVENT = "summary string, organizer struct<displayName:string,email:string>, attendees array<struct<displayName:string,email:string>>, recurringEventId string, location string, description string"


def parse(events: DataFrame) -> DataFrame:
    """Events of the first shape: subject, organizer, attendees by name or else address, series, place, 500 characters of the body."""
    who = lambda e: F.coalesce(F.nullif(e["emailAddress"]["name"], F.lit("")), e["emailAddress"]["address"], F.lit(""))
    keep = [c for c in events.columns if c not in ("subject", "organizer", "attendees", "recurrence", "location", "bodyPreview")]
    recurring = F.col("recurrence").isNotNull()
    return events.select(*keep, F.coalesce("subject", F.lit("")).alias("subject"), who(F.col("organizer")).alias("organizer"), F.filter(F.transform(F.coalesce("attendees", F.array()), who), lambda n: n != "").alias("attendees"), recurring.alias("is_recurring"), F.when(recurring, F.col("subject")).alias("series_name"), F.coalesce("location.displayName", F.lit("")).alias("location"), F.left(F.coalesce("bodyPreview", F.lit("")), F.lit(500)).alias("body_preview"))


def parse_other(events: DataFrame) -> DataFrame:
    """Events of the second shape, to the same columns."""
    who = lambda e: F.coalesce(F.nullif(e["displayName"], F.lit("")), e["email"], F.lit(""))
    keep = [c for c in events.columns if c not in ("summary", "organizer", "attendees", "recurringEventId", "location", "description")]
    recurring = F.col("recurringEventId").isNotNull()
    return events.select(*keep, F.coalesce("summary", F.lit("")).alias("subject"), who(F.col("organizer")).alias("organizer"), F.filter(F.transform(F.coalesce("attendees", F.array()), who), lambda n: n != "").alias("attendees"), recurring.alias("is_recurring"), F.when(recurring, F.col("summary")).alias("series_name"), F.coalesce("location", F.lit("")).alias("location"), F.left(F.coalesce("description", F.lit("")), F.lit(500)).alias("body_preview"))
