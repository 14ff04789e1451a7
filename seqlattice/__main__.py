from .jobs import main

raise SystemExit(main())
