"""Where tables come from: files, services, documents, and the driver's tables."""
