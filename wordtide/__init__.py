"""Analytics over timestamped prose with PySpark: rising words, ladders, reports and their history."""
