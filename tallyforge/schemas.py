"""Fixed schemas of the order tables."""

from pyspark.sql import types as T

#: The raw file's columns in file order, all text.
RAW_COLUMNS = (
    "order_id order_date status customer_id customer_name customer_phone customer_email city district "
    "delivery_type delivery_cost payment_method payment_status payment_amount currency total_amount items_json"
).split()
RAW_RECORD = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
CORRECTION = "struct<rule_code: string, field: string, original_value: string, corrected_value: string, reason: string>"
ITEM = "struct<sku: string, name: string, qty: bigint, unit_price: double, total: double>"
VALIDATED_COLUMNS = (
    "classification id_order order_date status customer_id customer_name customer_phone customer_email city district delivery_type "
    "delivery_cost payment_method payment_status payment_amount currency total_amount items quality_status corrections id_run source_file "
    "source_row_number processed_at raw_record"
).split()
QUARANTINE_COLUMNS = "classification id_order id_run source_file source_row_number error_codes quarantine_reason raw_record detected_at".split()
