"""Where stores, texts and files come from and go to."""
