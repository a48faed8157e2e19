"""Operation-log analytics on Spark: what an ordered log of puts, deletes, range deletes and counter adds says at any point of its sequence."""
