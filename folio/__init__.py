"""folio: a PySpark-native analytics engine for digitized document collections."""
