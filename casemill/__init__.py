"""casemill: incident and case-record analytics as Spark DataFrame operators."""
