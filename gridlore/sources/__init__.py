"""Reading and writing: files, typed ranges, JDBC, result history."""
