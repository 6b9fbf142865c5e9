"""Record operators: filters, access rules, validity, fields, reshaping."""
