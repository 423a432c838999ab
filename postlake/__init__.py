"""Job-posting analytics on Spark: pages, payloads and listings in; detections,
chunks, records and upserted tables out."""
