"""Sources and sinks: the driver's parquet tables, CSV/JSON files and the
derived "messy" views built from them by the defect injectors."""
