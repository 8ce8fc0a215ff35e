"""Types and the identifier vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T

#: The identifier types, in the order that defines label ids.
IDENTIFIER_TYPES = (
    "account_pin", "api_key", "bank_routing_number", "bban", "company", "credit_card_number", "credit_card_security_code", "customer_id", "date", "date_of_birth",
    "date_time", "driver_license_number", "email", "employee_id", "iban", "ipv4", "ipv6", "first_name", "last_name", "local_latlng", "name", "passport_number", "password",
    "phone_number", "ssn", "street_address", "swift_bic_code", "time", "user_name",
)
#: Types that identify nobody.
NON_IDENTIFYING = ("company", "date", "time", "date_time")
IDENTIFYING = tuple(t for t in IDENTIFIER_TYPES if t not in NON_IDENTIFYING)
BIO_LABELS = ("O", *(f"{p}-{t}" for t in IDENTIFIER_TYPES for p in "BI"))

SPAN = T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("label", T.StringType())])
CORPUS = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("doc_type", T.StringType())])

#: Defaults of the gate.
THRESHOLD, BUDGET = 0.2, 0.12
