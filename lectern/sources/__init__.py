"""Where tables come from and go to: files, and exports."""
