"""Urgency lists from surgical booking records, as Spark DataFrame jobs."""
